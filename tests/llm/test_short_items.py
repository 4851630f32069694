"""Short test items, and items in scripts without blanks, inside training texts."""

from terrastat.llm.decontaminate import benchmark_hits, decontaminated


def test_short_items_are_found_as_they_are(spark):
    items = [(1, "Name the red planet?"), (2, "東京はどこですか"), (3, "Ozymandias"), (4, "..."), (5, "水"), (6, "ภาษาไทย ง่าย"), (6, "name the red planet"), (7, "二十 world")]
    docs = [
        (1, "please (name the\nRED planet), thanks"),
        (2, "name the red dwarf planet"),
        (3, "ab 問題。東京は どこですか？答え"),
        (4, "東京はどこ"),
        (5, "the red"),
        (6, "planet name the red"),
        (7, "xภาษาไทยง่ายx ... 水"),
        (8, "look on Ozymandias' works; ozymandias!"),
        (9, None),
        (None, "name the red planet"),
    ]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.passage_start, r.question_overlap, r.answer_overlap) for r in benchmark_hits(docs, items).collect()}
    assert got == {(1, 1, 1, 1.0, 1.0), (1, 6, 1, 1.0, 1.0), (3, 2, 1, 1.0, 1.0), (7, 6, 0, 1.0, 1.0), (8, 3, 2, 1.0, 1.0)}
    assert {r.doc_id for r in decontaminated(docs, items).collect()} == {2, 4, 5, 6, 9, None}
