"""Secret scans over an incremental blob ledger.

A blob is a text's SHA-256. The ledger has one row for each blob and rule version that was
scanned, with its findings. A scan hashes every historical version of every path, scans only the
blobs that the ledger lacks under the current rule version, one copy of each, adds them to the
ledger, and joins findings back to all paths by blob. All of it is DataFrame functions.

Rows: a null text is the empty blob. Rows without an id or with a repeated one are paths like
any other. Columns of the input other than the text are kept; blob and findings replace columns
of these names. Long texts with many matches take time in proportion to the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.llm.spans import cut, listed, matches, unused
from hearthline.storage import written

RULE_VERSION = 1
BROADCAST_ROWS = 200_000  # keys of about 100 bytes; beyond that they are joined by a shuffle

#: Fixed rules: (kind, pattern, least length of the match, or for assign of its value).
BASE = [
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12),
    ("access", r"AKIA[A-Z0-9]+", 18),
    ("hex", r"[0-9a-f]{16,}", 16),
]
ADDED = [
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 1),
]
KINDS = [kind for kind, _, _ in [*BASE, *ADDED]]
#: What follows a pem header: up to its END line, or if that is missing its header lines and base64.
PEM_REST = r"^[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
PEM_CUT = r"^(?:(?:\s|\\[nr])*+(?:[A-Za-z-]++:\x20[^\n]*+|[A-Za-z0-9+/=]{16,}+))*+"
FINDING = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _kind(hits: Column, rank: int, kind: str, least: int) -> Column:
    #: of an assignment the value counts: what follows the first : or = and its quote
    value = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?(.*)$" if kind == "assign" else "^(.*)$"
    kept = F.filter(hits, lambda x: F.length(F.regexp_extract(x["value"], value, 1)) >= least)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(text: Column) -> Column:
    """array<struct<start, rank, end, kind>> by start, then rank (the kind's place in KINDS)."""
    found = [_kind(matches(text, pattern), rank, kind, least) for rank, (kind, pattern, least) in enumerate([*BASE, *ADDED])]
    return F.array_sort(F.concat(*found))


def blobs(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.unhex(F.sha2("text", 256)))


def unseen(versions: DataFrame, ledger: DataFrame | None, rule_version: int) -> DataFrame:
    """blob, text: one copy of each blob that the ledger lacks under this rule version.

    The copy is that with the smallest (doc_id, crc32). Other copies are left out by their key,
    so texts move only if there are more copies than a broadcast may hold."""
    keys = versions.select("blob", "doc_id")
    first = keys.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    first = written(first, "blobs")
    wanted = written(keys.select("blob", "doc_id").distinct().join(first.withColumnRenamed("doc_id", "own"), "blob", "left").where("own is null or not (own <=> doc_id)").where("doc_id is not null").select("blob", "doc_id"), "copies")
    few = wanted.count() <= BROADCAST_ROWS
    alone = versions.select("blob", "doc_id", "text").join(F.broadcast(wanted) if few else wanted, ["blob", "doc_id"], "left_anti")
    return alone.select("blob", "text")


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(paths with their blob, the ledger with what this scan added).

    Ledger: blob binary, rule_version int, findings array<struct<start, rank, end, kind>>."""
    versions = blobs(docs)
    new = unseen(versions, ledger, rule_version)
    scanned = new.select("blob", F.lit(rule_version).alias("rule_version"), scan(F.col("text")).alias("findings"))
    # rows that repeat a whole path were scanned each; the ledger keeps one
    added = written(scanned.dropDuplicates(["blob"]), "ledger")
    return versions.drop("text"), added if ledger is None else ledger.unionByName(added)


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """Every path (row of docs, without its text) with its blob and findings."""
    docs = docs.drop("findings")
    paths, ledger = update_ledger(docs, ledger, rule_version)
    current = ledger.where(F.col("rule_version") == rule_version).select("blob", "findings")
    hits = current.where(F.size("findings") > 0)
    return paths.join(hits, "blob", "left").withColumn("findings", F.coalesce("findings", F.expr(f"cast(array() as {FINDING})")))


def digest(found: DataFrame) -> DataFrame:
    of = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: listed(x["kind"], x["start"], x["end"])), ",")
    base = F.filter("findings", lambda x: x["rank"] < len(BASE))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every finding's text replaced by mark; overlapping findings are one.
    A private key goes with its header, to its END line. Findings are those of the text's blob,
    whatever the doc_id. Columns are those of docs, whatever their names."""
    columns, own, found = docs.columns, unused(docs, "blob"), unused(docs, "findings")
    _, ledger = update_ledger(docs.select("doc_id", "text"))
    hits = written(ledger.where(F.size("findings") > 0).select(F.col("blob").alias(own), F.col("findings").alias(found)), "findings")
    few = hits.count() <= BROADCAST_ROWS
    joined = docs.withColumn(own, F.unhex(F.sha2("text", 256))).join(F.broadcast(hits) if few else hits, own, "left")

    def whole(x: Column) -> Column:
        """A finding with its whole secret: a pem finding is the header line of a key."""
        rest = F.substring(F.col("text"), x["end"] + 1, F.length("text"))
        ended = F.length(F.regexp_extract(rest, PEM_REST, 0))
        more = F.when(ended > 0, ended).otherwise(F.length(F.regexp_extract(rest, PEM_CUT, 0)))
        return F.struct(x["start"].alias("start"), F.when(x["kind"] == "pem", x["end"] + more).otherwise(x["end"]).alias("end"))

    clean = F.when(F.size(found) > 0, cut(F.col("text"), F.transform(found, whole), mark)).otherwise(F.col("text"))
    return joined.withColumn("text", clean).select(*(f"`{c}`" for c in columns))
