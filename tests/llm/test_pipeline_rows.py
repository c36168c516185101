"""Near-duplicate stage of the pipeline on repeated ids, repeated rows and rows without an id."""

import corpus_pipeline as cp

A = "a " + " ".join(f"w{i}" for i in range(60))
B = "b " + " ".join(f"v{i}" for i in range(60))


def stage(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", s, 1, "x") for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    out = cp.near_duplicates(spark, docs, "")
    assert out.columns == cp.COLUMNS
    return sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=repr)


def test_a_repeated_id_loses_its_copy_and_keeps_its_own_text(spark):
    assert stage(spark, [(3, A, "s"), (5, A, "s"), (5, B, "s")]) == [(3, A, "s"), (5, B, "s")]
    assert stage(spark, [(5, A, "s"), (5, A + " more", "s"), (7, A, "s")]) == [(5, A + " more", "s")]


def test_rows_without_an_id_stay_and_repeated_rows_are_one(spark):
    got = stage(spark, [(None, A, "s"), (None, A, "s"), (1, A, "s"), (1, A, "t"), (2, None, "s"), (2, "", "s"), (2, None, "s")])
    assert got == sorted([(None, A, "s"), (None, A, "s"), (1, A, "t"), (2, None, "s"), (2, "", "s")], key=repr)


def test_thousands_of_repeated_rows(spark):
    rows = [(i % 40, A if i % 2 else B, "s") for i in range(4000)] + [(100 + i, f"c{i} " + B[2:].replace("v", f"u{i}x"), "s") for i in range(50)]
    assert stage(spark, rows) == sorted([(0, B, "s"), (1, A, "s"), *((100 + i, f"c{i} " + B[2:].replace("v", f"u{i}x"), "s") for i in range(50))], key=repr)


def test_rows_that_surely_stay_are_not_dealt_out(spark, monkeypatch):
    """400 texts of their own, 6 copies, a row twice and a row without an id: only rows in question are joined by name."""
    seen, plain = [], cp._apart

    def counting(docs, marks):
        once, rest = plain(docs, marks)
        seen.append((marks.count(), once.count(), rest.count()))
        return once, rest

    monkeypatch.setattr(cp, "_apart", counting)
    texts = [f"x{i} " + A.replace("w", f"t{i}y") for i in range(400)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1000 + i, texts[i], "s") for i in range(6)] + [(20, texts[20], "r"), (None, texts[1], "s")]
    assert stage(spark, rows) == sorted([*((i, t, "s") for i, t in enumerate(texts)), (None, texts[1], "s")], key=repr)
    assert seen[0][0] == 7 and 8 <= seen[0][2] <= 60 and seen[0][1] + seen[0][2] == 407
