"""What ``run_all`` says of Latin-1 texts without running whole detectors is what these say."""

from pyspark.sql import functions as F

from glyphloom.operators import admission, detectors


def texts():
    latin = [chr(c) for c in range(1, 256)]
    yield from latin
    yield from (c + d for c in "I\xadß" for d in latin)
    yield from (c * 40 for c in latin[159:])
    yield from ("", "".join(latin), "a\xadb\xadc", "delve into\xad it", "a tapestry, I say", "ÌÍ i", "x" * 300 + "\xad" + "y" * 300 + "ß", "ªb", "a¼", "İ I", "ȧİ")


def test_latin_verdicts(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "id int, t string").repartition(2).cache()
    latin, names = F.col("t").rlike(detectors.LATIN_1), list(detectors.ON_LATIN_1)
    found = rows.where(latin).select("t", *[F.struct(detectors.FAMILIES[n][1](F.col("t")).alias("whole"), detectors.ON_LATIN_1[n](F.col("t")).alias("short")).alias(n) for n in names])
    seen = set()
    for r in found.collect():
        for n in names:
            assert r[n]["whole"] == r[n]["short"], (n, r["t"])
            seen |= {n} if r[n]["whole"]["tag"] else set()
    assert seen >= {"zeroWidthPayload", "localeCaseInversion", "caseExpansionMismatch", "identifierFormDrift", "aiWatermarkDetectability"}


def test_tags_without_positions(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a.b.c.d I", "", None, "Straße ‮ x", "\U000e0041 é"])], "id int, t string")
    families = ("filenameDisguise", "localeCaseInversion", "caseExpansionMismatch", "tagBlockPayload", "bidiControlBalance")
    plain = {r["id"]: r["verdicts"] for r in admission.run_all(rows, "t", families).collect()}
    tags = {r["id"]: r["verdicts"] for r in admission.run_all(rows, "t", families, positions=False).collect()}
    assert [[v["tag"] for v in plain[i]] for i in plain] == [[v["tag"] for v in tags[i]] for i in plain]
    assert not any(v["positions"] for r in tags.values() for v in r) and any(v["positions"] for r in plain.values() for v in r)


def test_names_are_sought_in_short_texts_only(spark, monkeypatch):
    """Texts with more letters than a name are not taken apart; those that shrink to a name are."""
    seen, whole = [], detectors.confusables.letter_skeleton
    monkeypatch.setattr(detectors.confusables, "letter_skeleton", lambda s, *more: seen.append(s) or whole(s, *more))
    name = next(t for t in detectors.curated.TARGETS if "a" in t)
    spoofed = name.replace("a", "\u0430")
    texts = [spoofed, spoofed + "\u0301\u00ad" * 500, name, "long word " * 100, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["target"] for r in detectors.with_target(rows, "t").collect()}
    assert got == {0: name, 1: name, 2: None, 3: None, 4: None, 5: None}
    assert {r["id"]: r["x"] for r in rows.select("id", seen[-1].alias("x")).collect()}[3] is None
    # each ASCII letter and digit leaves a letter, beside others too
    alone = spark.createDataFrame([(c,) for c in map(chr, range(128)) if c.isalnum()], "t string")
    assert all(r["n"] >= 1 for r in alone.select(F.length(whole(F.col("t"))).alias("n")).collect())
