"""Sources, dictionary, manifests, states and HTML on small inputs."""

import json
import urllib.error
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from inkweave import cli
from inkweave.operators import dictionary, evaluation, html, manifest
from inkweave.sources import attempts, config, models, references, sinks, texts


def test_line_rules(spark, tmp_path):
    (tmp_path / "7.txt").write_text("## head\n  ## inner \n\n one \r\ntwo\n12\n", encoding="utf-8")
    files = texts.read_files(spark, str(tmp_path / "7.txt"))
    assert [r.text for r in texts.verse_lines(files).collect()] == ["one", "two", "12"]
    assert [r.text for r in texts.prose_lines(files).collect()] == ["## inner", "one", "two", "12"]
    rows = [(r.line, r.number, r.text) for r in texts.dictionary_lines(files).orderBy("line").collect()]
    assert rows == [(0, 1, "## head"), (1, 2, "## inner"), (2, 4, "one"), (3, 5, "two")]


def test_reference_loading(spark):
    catalogue = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 10, "a"), (2, 12, "c")], "cat_id bigint, id bigint, title string")
    poems = spark.createDataFrame([(10, "a", None, ["x", "y"]), (12, "c", None, [" "])], references.POEM)
    with pytest.raises(RuntimeError, match="missing poem 11"):
        references.load_reference(catalogue, poems)
    assert references.load_reference(catalogue, poems, partial=True).where("poem_id = 10").count() == 2
    later = poems.where("id = 12").withColumn("title", F.lit("z"))
    assert sorted(r.id for r in references.by_priority(poems.where("id = 10"), later).collect()) == [10, 12]


def test_fetching(tmp_path):
    waits, answers = [], [429, 503, None]

    def opened(url, timeout):
        code = answers.pop(0)
        if code:
            raise urllib.error.HTTPError(url, code, "", {}, None)
        return __import__("io").BytesIO(b'{"a": 1}')

    assert references.fetch_json("http://x", wait=waits.append, opened=opened) == {"a": 1} and waits == [1, 2]
    answers[:] = [403]
    with pytest.raises(urllib.error.HTTPError):
        references.fetch_json("http://x", wait=waits.append, opened=opened)
    path = tmp_path / "w" / "c.json"
    assert references.cached(path, lambda: [1]) == [1] and references.cached(path, lambda: [2]) == [1]
    (tmp_path / "p.json").write_text("1")
    assert references.move_flat_files(tmp_path, {"p.json": "w"}) == ["p.json"] and references.move_flat_files(tmp_path, {"p.json": "w"}) == []
    pages = {1: "a b", 2: "b c", 3: "c"}
    assert references.follow_pages(pages.get, str.split) == ["a", "b", "c"]


def test_models():
    with pytest.raises(ValueError):
        models.read_page("a.jpg", lambda *_: {}, "poster")
    assert models.coerce_json('[1, {"a": 2}]') == {"a": 2}
    states, asked = {"a": "complete", "b": "pending", "c": "pending"}, []

    def model(image, mode):
        asked.append(image)
        if image == "c":
            raise OSError("no")
        return {"text": "t"}

    assert models.read_pages(["a", "b", "b", "c"], states.get, model, lambda i, r: "complete") == {"a": "complete", "b": "complete", "c": "error: no"}
    assert asked == ["b", "c"]


def test_settings(tmp_path):
    (tmp_path / "1.jpg").touch()
    (tmp_path / "p.toml").write_text('[alignment]\nmin_lines = 3\nreview_lines = 5\n[pages]\nimages = ["*.jpg", "1.*g"]\n')
    got = config.load(str(tmp_path / "p.toml"), {"review_lines": 1, "min_lines": None}, {"INKWEAVE_MIN_LINES": "9", "INKWEAVE_MIN_JACCARD": "0.7"})
    assert (got["min_lines"], got["review_lines"], got["min_jaccard"], len(got["pages"])) == (3, 1, 0.7, 1)
    with pytest.raises(ValueError):
        config.checked(config.DEFAULTS | {"min_monotone": 2})


LINES = ["اتب   وہ لفظ جو پہلے آئے۔", "دوسری سطر۔", "اجب (Term) ایک لفظ ہے۔", "اخر دیکھیے اتب، اجب۔", "بےحد", "کوئی سطر نہیں", "بات وہ چیز جو کہی جائے", "تاج   سر پر رکھنے کی چیز۔"]


def test_dictionary(spark):
    rows = [("b", "1" if i < 4 else "2", 1 if i < 4 else 2, i, t, False) for i, t in enumerate(LINES, 1)]
    lines = spark.createDataFrame(rows, "book string, page string, page_no bigint, line bigint, text string, corrupt boolean")
    found = dictionary.spans(lines).persist()
    got = {r.headword: r for r in dictionary.entries(found).collect()}
    assert got["اتب"].definition == "وہ لفظ جو پہلے آئے۔\nدوسری سطر۔" and got["اتب"].id == "b-1-001" and got["اتب"].source.end.line == 2
    assert got["اجب"].english_terms == ["Term"] and got["اجب"].quality.score == 0.85
    assert (got["اخر"].entry_type, got["اخر"].definition, got["اخر"].cross_references, got["اخر"].quality.score) == ("cross_reference", "", ["اتب", "اجب"], 0.98)
    assert "boundary_inferred" in got["اتب"].quality.flags and got["تاج"].id.startswith("b-2-00")
    lost = {r.rule: r for r in dictionary.unresolved(found).collect()}
    assert lost["no_boundary"].raw_text == "بےحد\nکوئی سطر نہیں"
    assert dictionary.retained(dictionary.entries(found)).count() == 4
    back = dictionary.recovered(dictionary.entries(found), dictionary.unresolved(found)).collect()
    assert isinstance(back, list)


def test_dictionary_rules(spark):
    key = lambda t: spark.range(1).select(dictionary.sort_key(F.lit(t))).first()[0]
    assert key("اب ت") == [1, 3, 0, 5] and key("a")[0] == 1000 + ord("a") and key("مؤ") == key("مو")
    valid = lambda t: spark.range(1).select(dictionary.valid_head(F.lit(t))).first()[0]
    assert valid("اتب") and not valid("ا") and not valid("کے بعد") and not valid("word") and not valid("اتب۔")


def test_model_entries(spark):
    good = {"headword": "h", "definition": "d", "raw_text": "r", "entry_type": "definition", "english_terms": [], "cross_references": [], "pages": ["1"], "examples": [], "quality": {"score": 0.5, "flags": []}}
    entries = [good, good | {"headword": " "}, good | {"definition": ""}, good | {"pages": ["9"]}, good | {"quality": {"score": 3, "flags": []}}, good]
    answers = spark.createDataFrame([("r1", json.dumps({"entries": entries}), ["1", "2"])], "response string, text string, allowed array<string>")
    rows = dictionary.validated(answers, "set").orderBy("sequence").collect()
    assert [r.problem for r in rows] == [None, "invalid headword", "empty definition", "invalid pages", "invalid quality score", None]
    assert (rows[0].id, rows[5].sequence) == ("set-1-001", 6)


def test_states(spark):
    ok = json.dumps({"finish": "STOP", "text": "t "})
    files = {"a": [(".txt", "t"), (".response.json", ok)], "b": [(".txt", "u"), (".response.json", ok)], "c": [(".txt", "t")], "d": [(".partial.txt", "x")], "e": [(".attempts/1.response.json", ok)], "f": [(".txt", "t"), (".response.json", "[]")], "g": [], "h": [(".txt", "")]}
    rows = [(p + ".jpg", "") for p in files] + [(p + end, content) for p, x in files.items() for end, content in x]
    got = dict(manifest.page_states(spark.createDataFrame(rows, "path string, content string")).collect())
    assert got == {"a": "complete", "b": "edited", "c": "unrecorded", "d": "partial", "e": "failed", "f": "corrupt", "g": "pending", "h": "pending"}
    assert dict(manifest.state_counts(spark.createDataFrame(list(got.items()), "page string, state string")).collect())["pending"] == 2


def test_manifest_round_trip(spark, tmp_path):
    images = spark.createDataFrame([(f"/x/p {i}.jpg", "ab", f"text {i}", True, "STOP", "verse", "m") for i in range(40)], "image string, image_sha256 string, text string, has_response boolean, finish string, mode string, model string")
    rows = manifest.build_manifest(images, "My set")
    path = str(tmp_path / "m")
    sinks.write_json(rows, path)
    back = sinks.read_manifest(spark, path)
    assert back.count() == 40 and rows.first().id == "My-set-p-0"
    with pytest.raises(ValueError, match="neither"):
        sinks.exportable(back)
    with pytest.raises(ValueError, match="differs"):
        sinks.export_pages(back, spark.createDataFrame([], "path string, content binary"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() and sinks.exportable(back, True).count() == 40
    with pytest.raises(ValueError, match="used twice"):
        manifest.build_manifest(images.union(images.limit(1)), "s")
    with pytest.raises(ValueError, match="not complete"):
        manifest.build_manifest(images.withColumn("finish", F.lit("MAX")), "s")


def test_html_cut_inside_a_reference(spark):
    texts = ["the&&&amp", "a &am", "b &amp; &quot;c&quot; &copy;2 &middot; &#65;&#x42; &nosuch; &ampx;", "&amp;amp; &amp;quot;"]
    rows = spark.createDataFrame([(f"<title>{t}</title><p>{t}</p>",) for t in texts], "h string").select(html.visible_lines(F.col("h")).alias("v"), html.kept_lines(F.col("h"), chrome=(), rule=(1, 0.1, 200)).alias("k")).collect()
    shown = ["the&&&amp", "a &am", 'b & "c" ©2 · AB &nosuch; &ampx;', "&amp; &quot;"]
    assert [r.v for r in rows] == [[t, t] for t in shown] and [r.k for r in rows] == [[t] for t in shown]


def test_html(spark):
    page = '<script>x</script><p>A first line of text &amp; more</p><br/>tiny<div>A first line of text &amp; more</div><a href="https://h.org/poems/one?x=1#a">n</a><a href="/poems/one">m</a><a href="/other">o</a>'
    row = spark.createDataFrame([(page,)], "h string").select(html.visible_lines(F.col("h")).alias("v"), html.kept_lines(F.col("h"), chrome=()).alias("k"), html.links(F.col("h"), "^/poems/[^/]+$").alias("l")).first()
    assert row.v[:2] == ["A first line of text & more", "tiny"] and row.k == ["A first line of text & more"] and row.l == ["/poems/one"]
    story = '<div class="pMC"><div class="w">short one here<div>x</div></div></div><div class="pMC x"><div class="w"><p>first long\n paragraph</p></div><div class="w">second long paragraph</div></div>'
    assert html.story_of(story) == ["first long paragraph", "second long paragraph"]
    assert html.stories(spark.createDataFrame([(story,), (None,)], "html string")).select("story").collect()[1].story == []


def test_refrains_and_sweep(spark):
    poems = spark.createDataFrame([("a", "p", [["x"], ["k", "l", "m", "n"], ["y"], ["z", "l", "m", "n"]]), ("b", "q", [["x"], ["m", "n"], [], ["l", "m", "n"]]), ("c", "q", [["x"], ["m"]])], "gid string, poet string, lines array<array<string>>")
    rows = evaluation.with_refrain(poems)
    assert {r.gid: r.radif for r in rows.collect()} == {"a": ["l", "m", "n"], "b": ["m", "n"], "c": []}
    scores = spark.createDataFrame([(0.9, True), (0.8, True), (0.5, False), (0.8, False)], "score double, present boolean")
    best = evaluation.sweep(scores).first()
    assert (best.cut, best.acc, best.recall, best.fpr) == (0.8, 0.75, 1.0, 0.5)
    assert evaluation.sweep(scores.where("present")).count() == 0


def a_reader(image, mode):
    name = image.rsplit("/", 1)[-1]
    answers = {"a.jpg": {"text": "one\ntwo\n", "finish": "STOP", "model": "m"}, "b.jpg": {"text": "cut", "finish": "MAX"}, "c.jpg": {"error": "no"}, "e.jpg": {"text": " "}}
    return answers.get(name) or {"text": f"text of {name}", "finish": "STOP"}


def an_extractor(parts):
    entry = {"headword": "آپ", "definition": "تعریف", "raw_text": "آپ تعریف", "entry_type": "definition", "english_terms": [], "cross_references": [], "pages": ["017"], "examples": [], "quality": {"score": 1.0, "flags": []}}
    return {"text": json.dumps([{"entries": [entry, entry | {"pages": [parts[-2]["image"][-7:-4]]}]}]), "model": "x"}


def test_attempts(tmp_path):
    image = tmp_path / "p.jpg"
    now = datetime(2024, 2, 3, 4, 5, 6, 7, UTC)
    assert attempts.new_attempt(now)["created_at"] == "2024-02-03T04:05:06.000007Z" and attempts.new_attempt(now)["id"].startswith("20240203T040506000007Z-")
    assert attempts.last_attempt(image) is None
    assert attempts.record(image, {"error": "x"}, {}) == "error" and attempts.record(image, {"text": " "}, {}) == "empty" and attempts.record(image, {"text": "half", "finish": "MAX"}, {}) == "partial"
    assert attempts.record(image, {"text": "whole ", "finish": "STOP"}, {"mode": "verse"}) == "complete"
    assert (tmp_path / "p.txt").read_text() == "whole\n" and (tmp_path / "p.partial.txt").read_text() == "half\n"
    assert attempts.record(image, {"text": "again", "finish": "STOP"}, {}) == "complete" and attempts.record(image, {"error": "later"}, {}) == "error"
    assert attempts.last_attempt(image)["error"] == "later" and (tmp_path / "p.txt").read_text() == "again\n"
    kept = sorted(p.name.split(".", 1)[1] for p in (tmp_path / "p.attempts").iterdir())
    assert kept == ["response.json"] * 6 + ["superseded.response.json", "superseded.txt"]
    assert not [p for p in tmp_path.rglob(".*")]


def test_commands(spark, tmp_path, capsys):
    scans = tmp_path / "scans"
    scans.mkdir()
    for x in "abcdef":
        (scans / f"{x}.jpg").write_bytes(x.encode())
    (scans / "d.txt").write_text("t")
    (scans / "e.txt").write_text("")
    me = "tests.test_sources"
    images = [str(scans / f"{x}.jpg") for x in "abcdf"]
    assert cli.main(["ocr", *images, "--reader", f"{me}:a_reader"]) == 1
    told = dict(reversed(x.split()) for x in capsys.readouterr().out.splitlines() if x.endswith(".jpg"))
    assert [told[x] for x in images] == ["complete", "partial", "error", "unrecorded", "complete"]
    assert cli.main(["ocr", images[0], images[4], "--reader", f"{me}:a_reader"]) == 0 and cli.main(["ocr", images[0], "--reader", "none"]) == 2
    assert cli.main(["states", str(scans)]) == 1
    out = capsys.readouterr().out
    assert "complete=2" in out and "unrecorded=1" in out and "partial=1" in out and "failed=1" in out and "pending=1" in out
    assert cli.main(["manifest", str(scans), "--dataset", "s", "--output", str(tmp_path / "m")]) == 2  # b, c and e have no text
    for x in "bce":
        (scans / f"{x}.jpg").unlink()
    assert cli.main(["manifest", str(scans), "--dataset", "s", "--output", str(tmp_path / "m"), "--status", "gold"]) == 0
    assert cli.main(["export", str(tmp_path / "m"), str(tmp_path / "out"), "--files", str(scans)]) == 0
    pages = {r.id: r for r in spark.read.parquet(str(tmp_path / "out" / "pages")).collect()}
    assert sorted(pages) == ["s-a", "s-d", "s-f"] and pages["s-a"].text == "one\ntwo\n" and bytes(pages["s-a"].image) == b"a" and pages["s-a"].export_image == "s-a.jpg"
    listed = [r.value for split in ("train", "validation", "test") for r in spark.read.text(str(tmp_path / "out" / f"{split}.lst")).collect()]
    assert sorted(listed) == ["s-a.jpg", "s-d.jpg", "s-f.jpg"]
    (scans / "a.txt").write_text("changed")
    assert cli.main(["export", str(tmp_path / "m"), str(tmp_path / "new"), "--files", str(scans)]) == 2 and not (tmp_path / "new").exists()
    assert cli.main(["export", str(scans / "d.txt"), str(tmp_path / "o"), "--files", str(scans)]) == 2


def test_commands_of_references_and_entries(spark, tmp_path, capsys, monkeypatch):
    answers = {"http://h/cat/7": [{"id": 1, "title": "x"}, {"id": 2, "title": "y"}], "http://h/poem/1": {"id": 1, "title": "x", "verses": ["a", "b"]}, "http://h/poem/2": {"id": 2, "title": "y", "verses": [" "]}}
    asked = []
    monkeypatch.setattr(references, "fetch_json", lambda url: asked.append(url) or answers[url])
    for _ in range(2):
        assert not cli.main(["fetch", "7", "--directory", str(tmp_path / "r"), "--listing", "http://h/cat/{id}", "--poem", "http://h/poem/{id}"])
    assert sorted(asked) == sorted(answers)
    (tmp_path / "scans").mkdir()
    (tmp_path / "scans" / "a.jpg").write_bytes(b"")
    reference = ["--catalogue", str(tmp_path / "r" / "cat_7.json"), "--poems", str(tmp_path / "r" / "poem_*.json")]
    assert cli.main(["verify", *reference]) == 1 and cli.main(["states", str(tmp_path / "scans"), *reference]) == 1
    assert "category 7: 2 poems, 0 missing, 1 empty" in capsys.readouterr().out
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "1.txt").write_text("a\nb\n")
    assert cli.main(["directory", str(tmp_path / "texts")]) == 0
    (tmp_path / "texts" / "2.txt").write_text("a\n")
    assert cli.main(["directory", str(tmp_path / "texts")]) == 1 and "1 usable, 1 invalid" in capsys.readouterr().out
    for x in ("017", "018"):
        (tmp_path / f"{x}.jpg").write_bytes(b"")
        (tmp_path / f"{x}.txt").write_text("reading")
    given = ["extract", str(tmp_path / "017.jpg"), str(tmp_path / "018.jpg"), "--response", str(tmp_path / "answer.json"), "--output"]
    assert not cli.main([*given, str(tmp_path / "e"), "--reader", "tests.test_sources:an_extractor"])
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "e")).collect()) == ["dictionary-017-001", "dictionary-018-001"]
    assert cli.main([*given, str(tmp_path / "e2"), "--reader", "tests.test_sources:an_extractor"]) == 2 and not cli.main([*given, str(tmp_path / "e3"), "--reuse-response"])
    with pytest.raises(ValueError, match="three digits"):
        models.request_parts([str(tmp_path / "a.jpg")])
