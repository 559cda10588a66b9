"""Secret scan with corpus-wide ownership (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspan.llm.common import checkpointed, fresh

# Fixed values of the contract: kind, pattern, least length of the match (assign: of its group 2).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: A kind that the method adds to the three: well-known prefixes of issued credentials, and private keys with their bodies (the header alone where none follows).
ISSUED = r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})|-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:\s*+[A-Za-z0-9-]++:[^\n]*+\n)*+[A-Za-z0-9+/=\s]*+-----END [A-Z ]*PRIVATE KEY-----)?"
#: A value is copied, not live, from so many owners on, or from so many repositories of at least two owners.
OWNERS, REPOSITORIES = 3, 50
# A maximal run of one class is at least n long iff the pattern with {n,} finds it, at the same place.
LONG_ACCESS = r"AKIA[A-Z0-9]{14,}"
LONG_HEX = r"[0-9a-f]{16,}"
#: Values of more repositories than SALTED are dealt to SALTS groups where they meet their documents.
SALTED, SALTS = 1000, 64
#: Matches that are scanned together.
RUN = 256
ORDER = ["assign", "access", "hex", "issued"]


def _spans(text: Column, pattern: str, kind: str, keep=None, value=None) -> Column:
    """array<struct<start,end,kind,value>> of the pattern's matches, in code points.

    The text is split at the matches; starts follow from the lengths of what lies between them.
    keep(match), value(match): whether a match counts, and the secret in it.
    """
    value = value or (lambda m: m)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), value(x["m"]).alias("value"))
        out = F.concat(acc["out"], F.array(span))
        return F.struct(end.alias("at"), (F.when(keep(x["m"]), out).otherwise(acc["out"]) if keep else out).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    # Runs of RUN matches are scanned from zero, and then moved to where they begin, so the work is not the square of the matches.
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")), lambda i: F.aggregate(F.slice(pairs, i * RUN + 1, F.lit(RUN)), zero, step))

    def move(acc: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(runs, zero, move, lambda acc: acc["out"])).otherwise(none)


def _assigned(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def find_column(text: Column) -> Column:
    """All spans of a text by (start, kind as listed, end): array<struct<start,rank,end,kind,value>>."""
    text = F.coalesce(text, F.lit(""))
    kinds = [
        _spans(text, ASSIGN, "assign", lambda m: F.length(_assigned(m)) >= LEAST["assign"], _assigned),
        _spans(text, LONG_ACCESS, "access"),
        _spans(text, LONG_HEX, "hex"),
        _spans(text, ISSUED, "issued"),
    ]
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(ORDER) for x in (k, i)])
    keyed = F.transform(F.concat(*kinds), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.array_sort(keyed)


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, source (null where there is no such column) and `found`, the text's spans."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", source.alias("source"), find_column(F.col("text")).alias("found"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(found: DataFrame, wide_owners: int = OWNERS, wide_repositories: int = REPOSITORIES) -> DataFrame:
    """For each candidate secret: by how many distinct repositories (documents) and owners (sources) it is held, and a verdict.

    Values are compared by 64-bit hash. Distinct (value, repository) and (value, owner) come first, with partial aggregation, so a value that
    a third of all rows hold is spread over its repositories before it is counted; a null repository or owner is one of its own.
    `copied`: held by `wide_owners` owners or more, or by `wide_repositories` repositories of two owners or more, as examples and documentation
    are; `live`: specific to its owners.
    """
    values = found.select("source", "doc_id", F.explode("found").alias("s")).select(
        F.xxhash64("s.value").alias("secret"),
        F.explode(F.array(F.struct(F.lit(True).alias("owner"), F.col("source").alias("name")), F.struct(F.lit(False).alias("owner"), F.col("doc_id").cast("string").alias("name")))).alias("holder"),
    )
    distinct = values.groupBy("secret", "holder.owner", "holder.name").agg(F.lit(1))
    counts = distinct.groupBy("secret").agg(F.count_if("owner").alias("owners"), F.count_if(~F.col("owner")).alias("repositories"))
    copied = (F.col("owners") >= wide_owners) | (F.col("owners") >= 2) & (F.col("repositories") >= wide_repositories)
    return counts.withColumn("verdict", F.when(copied, "copied").otherwise("live"))


def scan_secrets(docs: DataFrame, wide_owners: int = OWNERS, wide_repositories: int = REPOSITORIES) -> DataFrame:
    """Secrets of every text, with how widely each is copied over the corpus.

    Input: doc_id (the repository), text, source (the owner; other columns are ignored). Null text is the empty text; a null source
    is an owner of its own; equal rows are scanned each, and count as one repository. Spans may overlap between kinds. An empty table gives no rows.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_issued, n_live, n_copied (spans by verdict), max_repositories and
    max_owners (of its most widely held value; 0 without one).
    """
    found = find_spans(docs)
    base = F.filter("found", lambda s: s["kind"] != "issued")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    # Narrow rows without texts: every text is scanned once, and each row has one number from here on.
    report = checkpointed(
        found.select(
            "doc_id",
            "source",
            *[count(k).alias(f"n_{k}") for k in ORDER],
            F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
            joined(F.col("found")).alias("spans"),
            "found",
            F.monotonically_increasing_id().alias("row"),
        )
    )
    # A value that many rows hold is dealt by salt, and its counts go to each salt.
    uses = report.select("row", F.explode("found").alias("s")).select("row", F.xxhash64("s.value").alias("secret"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    owned = _salted(ownership(report, wide_owners, wide_repositories))
    held = (
        uses.join(owned, (uses["secret"] == owned["secret"]) & (uses["salt"] % owned["salts"] == owned["salt"]))
        .groupBy("row")
        .agg(
            F.count_if(F.col("verdict") == "live").alias("n_live"),
            F.count_if(F.col("verdict") == "copied").alias("n_copied"),
            F.max("repositories").alias("max_repositories"),
            F.max("owners").alias("max_owners"),
        )
    )
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(c, zero).alias(c) for c in ("n_live", "n_copied", "max_repositories", "max_owners")]
    return report.join(held, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_issued", *counts)


def redact(docs: DataFrame, wide_owners: int = OWNERS, wide_repositories: int = REPOSITORIES, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span of a live-looking secret replaced by `mask`; n_chars follows the text.

    Input as for `scan_secrets`; all columns stay, whatever their names. Texts without such a span stay as they are, null included. Only
    documents with candidates are joined; repeated rows are masked each; an empty table gives no rows.
    """
    columns = docs.columns
    found, row, live = fresh([*columns, "secret", "salt", "s"], "found", "row", "live")
    with_found = docs.withColumn(found, find_column(F.col("text")))
    clean = with_found.where(F.size(found) == 0).select(*columns)
    held = checkpointed(with_found.where(F.size(found) > 0).withColumn(row, F.monotonically_increasing_id()))
    owner = F.col("source") if "source" in columns else F.lit(None)
    verdicts = ownership(held.select("doc_id", owner.cast("string").alias("source"), F.col(found).alias("found")), wide_owners, wide_repositories).where("verdict = 'live'").select("secret")
    spans = held.select(row, F.explode(found).alias("s")).select(row, "s", F.xxhash64("s.value").alias("secret"))
    # A live value has few owners, but may be in every document of one.
    spots = spans.join(verdicts, "secret").groupBy(row).agg(F.array_sort(F.collect_set(F.struct("s.start", "s.end"))).alias(live))  # spans of one document
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.array(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate(live, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))))
    done = held.join(spots, row, "left").withColumn("text", F.when(F.col(live).isNull(), text).otherwise(masked))
    if "n_chars" in columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(done.select(*columns))


def _salted(owned: DataFrame) -> DataFrame:
    """Counts by secret and salt: a value of over SALTED repositories stands in SALTS copies."""
    salts = F.when(F.col("repositories") > SALTED, F.lit(SALTS)).otherwise(F.lit(1))
    return owned.withColumn("salts", salts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))


def secrets_sql() -> str:
    """The scan for DuckDB, with the contract's patterns as they are (matches that fail are dropped afterwards)."""
    issued = ISSUED.replace("*+", "*").replace("++", "+")
    kinds = [(ASSIGN, "length(regexp_extract(m, {p}, 2)) >= 12", "regexp_extract(m, {p}, 2)"), (ACCESS, "length(m) >= 18", "m"), (HEX, "length(m) >= 16", "m"), (issued, "true", "m")]
    parts = []
    for rank, (pattern, keep, value) in enumerate(kinds):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"""SELECT id, {rank} AS rank, '{ORDER[rank]}' AS kind, stop - length(m) AS start, stop, {value.format(p=p)} AS value FROM (
                SELECT id, m, sum(length(gap) + length(m)) OVER (PARTITION BY id ORDER BY i) AS stop FROM (
                    SELECT id, unnest(found) AS m, unnest(string_split_regex(text, {p})[:-2]) AS gap, unnest(range(len(found))) AS i
                    FROM (SELECT id, text, regexp_extract_all(text, {p}) AS found FROM docs) WHERE len(found) > 0)) WHERE {keep.format(p=p)}"""
        )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
owned AS (SELECT value, count(DISTINCT coalesce('s' || source, '')) AS owners, count(DISTINCT coalesce('d' || doc_id, '')) AS repositories FROM spans JOIN docs USING (id) GROUP BY value),
told AS (SELECT spans.*, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS name, owners, repositories, owners >= {OWNERS} OR owners >= 2 AND repositories >= {REPOSITORIES} AS copied FROM spans JOIN owned USING (value)),
each AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'issued') AS n_issued,
    coalesce(string_agg(name, ',' ORDER BY start, rank) FILTER (kind <> 'issued'), '') AS base, string_agg(name, ',' ORDER BY start, rank) AS spans,
    count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied, max(repositories) AS max_repositories, max(owners) AS max_owners FROM told GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_issued, 0) AS n_issued, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(max_repositories, 0) AS max_repositories, coalesce(max_owners, 0) AS max_owners
FROM docs LEFT JOIN each USING (id)
"""
