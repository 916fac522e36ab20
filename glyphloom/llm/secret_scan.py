r"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Three kinds of spans come from the text alone:

* ``assign``: a password, secret, token or API key that is given a value,
* ``access``: an access key id, ``AKIA`` and 16 or more capitals and digits,
* ``hex``: 24 or more lower-case hexadecimal digits.

The method adds ``bare`` spans: long tokens of mixed letters and digits outside those
spans. Every candidate value is hashed, and the corpus tells by how many distinct
repositories and owners it is held. A value held widely is a copied example; a value of
one owner in few repositories looks live. A bare token counts only if it looks live or
its value is elsewhere assigned to a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty, written

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: A shorter run never reaches the length, and nor does a match that starts inside it,
#: so asking for the length in the pattern gives the same spans as dropping short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A token of 20 or more characters with a capital, a small letter and a digit each.
BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"
#: A value in at least so many repositories of at least so many owners is an example.
EXAMPLE_REPOSITORIES = 3
EXAMPLE_OWNERS = 2
#: Chunk of the prefix sums below.
CHUNK = 256


def _ends(lengths: Column) -> Column:
    """Running sums of an int array, by chunks so that long arrays stay cheap."""
    n = F.size(lengths)
    zero = F.lit(0)
    add = lambda a, b: a + b
    chunks = F.transform(F.sequence(zero, F.ceil(n / CHUNK).cast("int")), lambda c: F.slice(lengths, c * CHUNK + 1, CHUNK))
    starts = F.aggregate(
        chunks,
        F.array(zero),
        lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + F.aggregate(c, zero, add)),
    )
    within = F.transform(
        chunks,
        lambda c, i: F.transform(c, lambda _, j: F.element_at(starts, i + 1) + F.aggregate(F.slice(c, 1, j + 1), zero, add)),
    )
    return F.flatten(within)


def spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Matches of ``pattern`` as structs ``(start, kind, end, value)``, in order.

    Each piece is a gap and the match after it, or the text's tail, so that the lengths
    add up to positions. The scan goes on where the last match ended and never starts
    over, whatever the text's length.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(.*?)(?:{pattern}|\z)"), F.lit(0))
    ends = _ends(F.transform(pieces, lambda p: F.length(p)))
    found = F.transform(
        F.arrays_zip(pieces.alias("p"), ends.alias("e")),
        lambda x: F.struct(F.regexp_extract(x["p"], pattern, 0).alias("m"), x["e"].alias("e"), F.regexp_extract(x["p"], pattern, group).alias("value")),
    )
    found = F.filter(found, lambda x: F.length(x["value"]) >= least)
    return F.transform(
        found,
        lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"), x["value"].alias("value")),
    )


SPAN_TYPE = "array<struct<start:int,kind:string,end:int,value:string>>"


def _or_none(hit: Column, found: Column) -> Column:
    return F.when(hit, found).otherwise(F.array().cast(SPAN_TYPE))


def base_spans(text: Column) -> Column:
    """The three kinds in one array, by start and then by kind as listed."""
    parts = F.concat(
        _or_none(text.rlike(ASSIGN_HINT), spans(text, ASSIGN, "assign", 2, 6)),
        _or_none(text.contains("AKIA"), spans(text, ACCESS, "access")),
        _or_none(text.rlike(HEX), spans(text, HEX, "hex")),
    )
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    keyed = F.array_sort(F.transform(parts, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x.alias("x"))))
    return F.transform(keyed, lambda k: k["x"])


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", owner_col: str | None = None
) -> DataFrame:
    """One row for each row of ``docs``: id, ``base`` spans, and ``found`` spans judged.

    ``found`` has a struct ``(start, kind_rank, kind, end, value, repositories, owners, verdict)``
    per span; ``verdict`` is ``example`` or ``live``. The owner is ``owner_col`` or, without
    one, the part of the repository before its first slash. Positions are code points.

    * A null text counts as empty and has no spans. A null repository or owner is not
      counted; a value held by none counts as one of an unknown owner.
    * Rows repeated with one id and text share a result; an empty table gives none.
    """
    text = text_or_empty(text_col)
    owner = F.col(owner_col) if owner_col else F.substring_index(F.col(repository_col).cast("string"), "/", 1)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(text, F.sha2(text, 256)).alias("_text"),
        F.col(repository_col).cast("string").alias("_repository"),
        owner.cast("string").alias("_owner"),
        base_spans(text).alias("base"),
        _or_none(text.rlike(BARE), spans(text, BARE, "bare")).alias("_bare"),
    )
    inside = lambda x: F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    rows = written(rows.withColumn("_bare", F.filter("_bare", lambda x: ~inside(x))), "secret-spans")

    each = rows.where("size(base) + size(_bare) > 0").select(
        "_id", "_text", "_repository", "_owner", F.explode(F.concat("base", "_bare")).alias("x")
    )
    each = each.withColumn("_hash", F.sha2("x.value", 256))
    held = each.groupBy("_hash").agg(
        F.count_distinct("_repository").alias("repositories"),
        F.count_distinct("_owner").alias("owners"),
        F.bool_or(F.col("x.kind") != "bare").alias("_named"),
    )
    example = (F.col("repositories") >= EXAMPLE_REPOSITORIES) & (F.col("owners") >= EXAMPLE_OWNERS)
    judged = (
        each.select("_id", "_text", "_hash", "x").distinct().join(held, "_hash")
        .withColumn("verdict", F.when(example, "example").otherwise("live"))
        .where("x.kind != 'bare' or _named or verdict = 'live'")
    )
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, "bare"))), F.col("x.kind"))
    one = F.struct(
        F.col("x.start").alias("start"), rank.alias("kind_rank"), F.col("x.kind").alias("kind"), F.col("x.end").alias("end"),
        F.col("x.value").alias("value"), "repositories", "owners", "verdict",
    )
    # the spans of one text: no more than the text has room for
    per_text = judged.groupBy(F.col("_id").alias("_i"), F.col("_text").alias("_t")).agg(F.array_sort(F.collect_set(one)).alias("found"))
    same = rows["_id"].eqNullSafe(per_text["_i"]) & (rows["_text"] == per_text["_t"])
    out = rows.join(per_text, same, "left")
    return out.select(F.col("_id").alias(id_col), "base", "found")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    verdicts = lambda v: F.coalesce(F.size(F.filter("found", lambda x: x["verdict"] == v)), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("found")), F.lit("")).alias("spans"),
        verdicts("live").alias("n_live"),
        verdicts("example").alias("n_example"),
    )
