"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are matched in every whole text. The hash of each candidate's value is then counted over the
whole corpus by distinct repositories and distinct owners. A value is a copied example (`example`) when
`copied_owners` owners or more hold it, or when at least two do and `copied_repositories` repositories or more; all
others are `live`. Many repositories of one owner are no sign of an example: an owner repeats a real credential in its
own documents as easily, and masking too much is the safer error. Rows without an owner are one owner together.
Generic long mixed tokens carry no keyword, so they count as secrets (`owned`) only when they are live by this rule;
this is what the method adds.

Defined cases: a null or empty text has no candidates; a null owner or repository counts as one of its own;
repeated rows are scanned each by itself and count once per repository; a null doc_id is kept as it is;
an empty table gives an empty result; other columns are ignored (scan) or kept as they are (redaction), whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofset.llm.common import free_name, quoted, text_key, written

# Patterns of the base kinds, in the order in which ties on the start are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # maximal runs, so the same matches as AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # maximal runs, so the same matches as [0-9a-f]+ of 24 characters or more
MIXED = r"[A-Za-z0-9_-]{20,}"
BASE_KINDS = ("assign", "access", "hex")

CANDIDATE = "array<struct<start:int,rank:int,end:int,kind:string,hash:string>>"


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each element combined with all before it, by doubling: element i takes in what element i - 2**k had, for
    every k, so the work is n log n and nothing is appended."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))

    def double(held, k):
        back = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(held, lambda x, i: F.when(i >= back, combine(x, F.get(held, i - back))).otherwise(x))

    return F.aggregate(steps, values, double)


def _placed(text: Column, matches: Column, pattern: str) -> Column:
    """(start, end) of each match in code points: the lengths of the pieces between matches, summed up."""
    pieces = F.split(text, pattern, -1)
    sizes = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.char_length(p) + F.char_length(m))
    return F.zip_with(matches, _running(sizes, lambda a, b: a + b), lambda m, end: F.struct((end - F.char_length(m)).alias("start"), end.alias("end")))


def _candidates(matches: Column, values: Column, spans: Column, kind: str, rank: int, least: int) -> Column:
    rows = F.arrays_zip(spans.alias("at"), values.alias("value"))
    kept = F.filter(rows, lambda x: F.char_length(x["value"]) >= least)
    return F.when(
        F.size(matches) > 0,
        F.transform(kept, lambda x: F.struct(x["at"]["start"].alias("start"), F.lit(rank).alias("rank"), x["at"]["end"].alias("end"), F.lit(kind).alias("kind"), F.sha2(x["value"].cast("binary"), 256).alias("hash"))),
    ).otherwise(F.expr(f"cast(array() as {CANDIDATE})"))


def find_candidates(rows: DataFrame) -> DataFrame:
    """rows with `candidates` in place of `text`: array of (start, rank, end, kind, hash of the value), by start and
    then kind."""
    t = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    found = rows.withColumns({
        "text": t,
        "m_assign": F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0)),
        "m_access": F.when(F.contains(t, F.lit("AKIA")), F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0))).otherwise(none),
        "m_hex": F.regexp_extract_all(t, F.lit(HEX), F.lit(0)),
        "m_mixed": F.regexp_extract_all(t, F.lit(MIXED), F.lit(0)),
    })
    nowhere = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "mixed": MIXED}
    found = found.withColumns({f"s_{k}": F.when(F.size(f"m_{k}") > 0, _placed(F.col("text"), F.col(f"m_{k}"), p)).otherwise(nowhere) for k, p in patterns.items()})
    found = found.withColumn("v_assign", F.when(F.size("m_assign") > 0, F.regexp_extract_all(F.col("text"), F.lit(ASSIGN), F.lit(1))).otherwise(none))
    mixed = F.transform("m_mixed", lambda m: F.when(m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]"), m).otherwise(""))
    parts = [
        _candidates(F.col("m_assign"), F.col("v_assign"), F.col("s_assign"), "assign", 0, 6),
        _candidates(F.col("m_access"), F.col("m_access"), F.col("s_access"), "access", 1, 20),
        _candidates(F.col("m_hex"), F.col("m_hex"), F.col("s_hex"), "hex", 2, 24),
        _candidates(F.col("m_mixed"), mixed, F.col("s_mixed"), "owned", 3, 20),
    ]
    return found.select(*[c for c in rows.columns if c != "text"], F.array_sort(F.concat(*parts)).alias("candidates"))


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, repositories, owners of each candidate value. Each step combines before it shuffles, so that a
    value which a third of all rows hold costs a few rows per task."""
    each = candidates.select(F.explode("candidates.hash").alias("hash"), "repository", "owner")
    per_repo = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("hits"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def label_candidates(rows: DataFrame, stats: DataFrame, key: str, copied_owners: int, copied_repositories: int, salts: int = 8) -> DataFrame:
    """key, spans (start, rank, end, kind, live): the candidates of a row with their class.

    The statistics are repeated `salts` times, so that the rows of one hot value are joined by as many tasks."""
    each = rows.select(key, F.explode("candidates").alias("c")).select(key, "c.*").withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    copied = (F.col("owners") >= copied_owners) | ((F.col("owners") >= 2) & (F.col("repositories") >= copied_repositories))
    salted = stats.select("hash", (~copied).alias("live"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    joined = each.join(salted, ["hash", "salt"]).filter((F.col("kind") != "owned") | F.col("live"))
    return joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "live"))).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", copied_owners: int = 5, copied_repositories: int = 25) -> DataFrame:
    """One row per input row: doc_id, spans (array of start, rank, end, kind, live), n_live, n_example.

    copied_owners, copied_repositories: when a value is a copied example (see above). The scan's narrow result is
    written once to the shared folder, so no text is matched twice."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(owner).alias("owner"), F.col(repository).alias("repository"), F.col(text).alias("text"))
    scan = written(find_candidates(rows).withColumn("row_id", F.monotonically_increasing_id()), "secrets")
    has = scan.filter(F.size("candidates") > 0)
    spans = label_candidates(has, ownership(has), "row_id", copied_owners, copied_repositories)
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,live:boolean>>)")
    out = scan.select("row_id", "id").join(spans, "row_id", "left").withColumn("spans", F.coalesce("spans", empty))
    return out.select(
        F.col("id").alias(doc_id),
        "spans",
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_example"),
    )


def redact_live(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", repository: str = "doc_id", copied_owners: int = 5, copied_repositories: int = 25, mask: str = "[SECRET]") -> DataFrame:
    """docs with every live secret replaced by `mask`; copied examples stay. Same columns, same rows.

    Every text is matched once. What is stored in between has places and hashes of values, and no text; it is
    joined to the documents by a hash of 128 bits of the text."""
    of_text = lambda t: F.struct(*[h.alias(c) for h, c in zip(text_key(t), "ab", strict=True)])
    rows = docs.select(F.col(owner).alias("owner"), F.col(repository).alias("repository"), of_text(F.col(text)).alias("key"), F.col(text).alias("text"))
    has = written(find_candidates(rows).filter(F.size("candidates") > 0), "secrets")
    spans = label_candidates(has.dropDuplicates(["key"]), ownership(has), "key", copied_owners, copied_repositories)
    live, key, cuts = F.col("live"), free_name(docs.columns, "text_key"), free_name(docs.columns, "cuts")
    upto = _running(live["end"], F.greatest)
    heads = F.filter(F.transform(live, lambda x, i: F.struct(x["start"].alias("start"), F.when(i == 0, 0).otherwise(F.get("upto", i - 1)).alias("before"))), lambda h: h["start"] >= h["before"])
    ends = F.concat(F.slice(F.col("heads")["before"], 2, F.size("heads")), F.array(F.element_at("upto", -1)))
    # overlapping live spans are one cut: it begins where no span before reaches, and ends where the next one begins to
    found = spans.select("key", F.filter("spans", lambda x: x["live"]).alias("live")).filter(F.size("live") > 0).withColumn("upto", upto).withColumn("heads", heads)
    places = written(found.select(F.col("key").alias(key), F.struct(F.col("heads")["start"].alias("start"), ends.alias("end")).alias(cuts)), "secrets-live")
    hit = docs.withColumn(key, of_text(F.col(text))).join(places, key, "left")
    at = F.col(cuts)
    kept = F.zip_with(F.concat(F.array(F.lit(0)), at["end"]), F.concat(at["start"], F.array(F.char_length(F.col(text)))), lambda a, b: F.substring(F.col(text), a + 1, b - a))  # what stands between the cuts
    fixed = {text: F.when(at.isNotNull(), F.array_join(kept, mask)).otherwise(F.col(text))}
    if "n_chars" in docs.columns:
        size = F.char_length(F.array_join(kept, mask))
        fixed["n_chars"] = F.when(at.isNotNull(), size.cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return hit.withColumns(fixed).select(*[quoted(c) for c in docs.columns])


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda x: x["rank"] < len(BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), "n_live", "n_example")
