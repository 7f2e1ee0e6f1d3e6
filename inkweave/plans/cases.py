"""Pairs of Urdu readings that a normalisation profile has to take for the same text, or to keep apart."""

# --- fixed values: a, b, profile, whether they merge, and the level they merge at or before ---
CASES = (
    ("ي", "ی", "apparatus", True, "encoding"),
    ("ك", "ک", "apparatus", True, "encoding"),
    ("نه", "نہ", "apparatus", True, "encoding"),
    ("می\u200cشود", "می شود", "apparatus", True, "encoding"),
    ("لاالہ", "لاالہ", "apparatus", True, "identical"),
    ("ســخن", "سخن", "apparatus", True, "encoding"),
    ("غالبؔ", "غالب", "apparatus", True, "orthographic"),
    ("اسدؔ", "اسد", "apparatus", True, "orthographic"),
    ("دیدۂ", "دیدہ", "apparatus", True, "orthographic"),
    ("حلقہٴ", "حلقۂ", "apparatus", True, "orthographic"),
    ("وادیٴ", "وادی", "apparatus", True, "orthographic"),
    ("مئے", "مے", "apparatus", True, "orthographic"),
    ("سوئے", "سوے", "apparatus", True, "orthographic"),
    ("صفاۓ", "صفاے", "apparatus", True, "orthographic"),
    ("”ہاں اور“", "ہاں اور", "apparatus", True, "orthographic"),
    ("ہے ہے ! خُدا نہ کردہ ، تجھے", "ہے ہے خدا نہ کردہ تجھے", "apparatus", True, "vocalisation"),
    ("اِس", "اس", "apparatus", True, "vocalisation"),
    ("قُدرت", "قدرت", "apparatus", True, "vocalisation"),
    ("مُکرّر", "مکرر", "apparatus", True, "vocalisation"),
    ("یا رب", "یارب", "apparatus", True, "segmentation"),
    ("صدہزار", "صد ہزار", "apparatus", True, "segmentation"),
    ("سخنور", "سخن ور", "apparatus", True, "segmentation"),
    ("درخور", "در خور", "apparatus", True, "segmentation"),
    ("ہے", "ہی", "retrieval", True, None),
    ("کھا", "کہا", "retrieval", True, None),
    ("ٹال", "تال", "retrieval", True, None),
    ("میں", "مین", "retrieval", True, None),
    ("آب", "اب", "retrieval", True, None),
    ("غالبؔ", "غالب", "retrieval", True, None),
    ("صدہزار", "صد ہزار", "retrieval-spaceless", True, None),
    ("۱۴۸", "١٤٨", "apparatus2", True, "encoding"),
    ("۱۴۸", "148", "apparatus2", True, "encoding"),
    ("ص ۴۳", "ص ٤٣", "apparatus2", True, "encoding"),
    ("۱۸:۷", "١٨:٧", "apparatus2", True, "encoding"),
    ("غالبؚ", "غالب", "apparatus", True, "orthographic"),
    ("اٙ", "ا", "apparatus", True, "vocalisation"),
    ("ہے", "ہی", "apparatus", False, None),
    ("آب", "اب", "apparatus", False, None),
    ("کھا", "کہا", "apparatus", False, None),
    ("کھانا", "کہانا", "apparatus", False, None),
    ("بھار", "بہار", "apparatus", False, None),
    ("ٹال", "تال", "apparatus", False, None),
    ("ڈال", "دال", "apparatus", False, None),
    ("گڑ", "گر", "apparatus", False, None),
    ("پھر", "پہر", "apparatus", False, None),
    ("میں", "مین", "apparatus", False, None),
    ("لبِ ساقی میں صلا میرے بعد", "لب ساقی پہ صلا میرے بعد", "apparatus", False, None),
    ("لے آئیں گے بازار سے جا کر دلِ جاں اور", "لے آئیں گے بازار سے جا کر دل و جاں اور", "apparatus", False, None),
    ("وہ آئے گھر میں ہمارے", "وہ آئیں گھر میں ہمارے", "apparatus", False, None),
    ("دلِ نالاں", "دلِ ناداں", "apparatus", False, None),
    ("دامِ سخت", "سخت قریب", "apparatus", False, None),
    ("بیت ۱", "بیت ۲", "apparatus", False, None),
    ("صفاۓ", "صفای", "apparatus", False, None),
    ("تپ", "تب", "apparatus", False, None),
    ("لبِ ساقی میں صلا", "لب ساقی پہ صلا", "retrieval", False, None),
    ("بیوفا", "بے وفا", "apparatus", False, None),
    ("کیونکر", "کیوں کر", "apparatus", False, None),
    ("۱۴۸", "۱۴۹", "apparatus2", False, None),
    ("۱۴۸", "۱۴", "apparatus2", False, None),
    ("ص ۴۳", "ص ۴۳۲", "apparatus2", False, None),
)
# --- end of fixed values ---
