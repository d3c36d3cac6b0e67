"""Secret scans (operator 6) with corpus-wide ownership frequency.

Candidates are spans of whole texts: the base kinds, and further kinds that alone are too weak a sign. For the hash of
every further candidate the corpus is asked how many distinct repositories and owners hold it: a string that many
repositories of several owners share is a copied example, one that many repositories of one owner repeat is its own
case, and any other is a live credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.token_counts import slices
from wikiloom.plans.shared import shared_table

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A hash that many documents hold meets its counts in so many parts.
SALT = 8
#: Kinds in the order in which spans with one start are listed: the base kinds, then those of this method.
BASE_KINDS = ("assign", "access", "hex")
#: Public formats of issued credentials.
FURTHER = {
    "private_key": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    "web_token": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "issued": re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{20,}|[sr]k_live_[A-Za-z0-9]{16,})"),
    "mixed": re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{32,}(?![A-Za-z0-9+/_=-])"),
}
KINDS = (*BASE_KINDS, *FURTHER)
HINTS = {"private_key": "PRIVATE KEY", "web_token": "eyJ"}
#: Kinds whose format alone is a strong sign: several owners are enough to share one, but it stays listed.
STRONG = ("private_key", "web_token", "issued")
#: A further candidate with at least so many owners, and if not strong so many repositories, is a copied example.
SHARED_OWNERS = 2
WIDE_REPOSITORIES = 10
#: A secret of at least so many bits for each character looks random (prose has less in short strings of few signs).
RANDOM_BITS = 3.0
SPAN_FIELDS = "struct<start: int, kind: int, stop: int, hash: string, bits: double>"
SPAN = f"array<{SPAN_FIELDS}>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, secret) of the base kinds, each leftmost and non-overlapping."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def further_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates of the further kinds that overlap neither a base span nor one of a kind listed before."""
    out: list[tuple[int, int, int, str]] = []
    for kind, pattern in FURTHER.items():
        if HINTS.get(kind, "") in text:
            new = [(m.start(), KINDS.index(kind), m.end(), m[0]) for m in pattern.finditer(text)]
            ends = sorted((a, b) for a, _, b, _ in [*taken, *out])
            starts = [a for a, _ in ends]
            upto = list(accumulate((b for _, b in ends), max))
            out += [x for x in new if (i := bisect_left(starts, x[2])) == 0 or upto[i - 1] <= x[0]]
    return sorted(out)


def digest(secret: str) -> str:
    """What stands for a secret in tables: never the secret itself."""
    return hashlib.sha256(secret.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def entropy(secret: str) -> float:
    """Bits for each character, by the frequencies of the secret's own characters."""
    return sum(-n / len(secret) * math.log2(n / len(secret)) for n in Counter(secret).values())


def candidates(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns ``keep`` and two arrays of (start, kind, stop, hash, bits): base and further, for every row."""
    fields = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("hash", pa.string()), ("bits", pa.float64())]))
        rows = lambda spans: [{"start": a, "kind": k, "stop": b, "hash": digest(s), "bits": round(entropy(s), 6)} for a, k, b, s in spans]
        for whole in batches:
            for batch in slices(whole, len(keep)):
                texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
                base = [base_spans(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(map(rows, base), kind), pa.array([rows(further_spans(t, b)) for t, b in zip(texts, base, strict=True)], kind)],
                    names=[*(f"k{i}" for i in range(len(keep))), "base", "further"],
                )

    source = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("__text"))
    return source.mapInArrow(scan, f"{fields}, base {SPAN}, further {SPAN}").select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "base", "further")


def ownership(found: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """hash, repositories, owners: over the whole corpus, how many distinct ones hold each candidate.

    Counted in steps (distinct triples, then per owner, then per hash), so that a string which a third of all documents
    hold is summed up before it is shuffled. An empty table gives no rows. A null repository or owner counts as one of its own.
    """
    each = found.select(F.explode(F.concat("base", "further")).alias("s"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))
    once = each.select(F.col("s.hash").alias("hash"), F.coalesce("repository", F.lit("\0")).alias("repository"), F.coalesce("owner", F.lit("\0")).alias("owner")).distinct()
    by_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("held"))
    return by_owner.groupBy("hash").agg(F.sum("held").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, shared_owners: int = SHARED_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """One row for each row of ``df``: id_col, base, live, shared, repeated (arrays of spans), base_live, base_random (counts).

    base: the base kinds. Further candidates are in one of three arrays. shared: ``shared_owners`` or more hold it, in
    ``wide_repositories`` or more (strong kinds: in any number), a copied example. repeated: fewer owners hold it, in
    ``wide_repositories`` or more, a template or a credential that its owner copied. live: all others. Strong kinds may
    be real wherever they are; ``reported`` lists them with live ones. base_live counts the base spans whose secret is
    held by fewer owners and repositories than both limits, base_random those of them that look random (RANDOM_BITS for
    each character or more); every span has its bits. repository_col: default id_col.
    A null text counts as empty and has no spans; a null owner is an owner of its own; repeated rows each get their
    row; an empty table gives no rows; other columns are not read.
    """
    repository_col = repository_col or id_col
    keep = tuple(dict.fromkeys((id_col, owner_col, repository_col)))
    row = F.monotonically_increasing_id()
    found = shared_table(candidates(df, text_col, keep).withColumn("__row", row), "secret-candidates")
    counted = shared_table(ownership(found, F.col(repository_col), F.col(owner_col)), "secret-owners")
    spans = found.select("__row", F.explode(F.concat("base", "further")).alias("s"), F.pmod("__row", F.lit(SALT)).cast("int").alias("salt")).withColumn("hash", F.col("s.hash"))
    # The counts grow with the corpus: they are merged, never broadcast.
    judged = spans.join(counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).hint("merge"), ["hash", "salt"]).groupBy("__row").agg(F.collect_list(F.struct("s", "owners", "repositories")).alias("all"))
    none = F.array().cast(f"array<struct<s: {SPAN_FIELDS}, owners: bigint, repositories: bigint>>")
    out = found.join(judged, "__row", "left").withColumn("all", F.coalesce("all", none))
    pick = lambda test: F.transform(F.filter("all", test), lambda x: x["s"])
    further = lambda x: x["s"]["kind"] >= len(BASE_KINDS)
    several = lambda x: x["owners"] >= shared_owners
    wide = lambda x: x["repositories"] >= wide_repositories
    shared = lambda x: several(x) & (wide(x) | strong(x["s"]))
    repeated = lambda x: ~several(x) & wide(x)
    own = lambda x: ~further(x) & ~several(x) & ~wide(x)
    return out.select(
        id_col,
        "base",
        pick(lambda x: further(x) & ~shared(x) & ~repeated(x)).alias("live"),
        pick(lambda x: further(x) & shared(x)).alias("shared"),
        pick(lambda x: further(x) & repeated(x)).alias("repeated"),
        F.size(F.filter("all", own)).cast("long").alias("base_live"),
        F.size(F.filter("all", lambda x: own(x) & (x["s"]["bits"] >= RANDOM_BITS))).cast("long").alias("base_random"),
    )


def strong(span: Column) -> Column:
    return span["kind"].isin([KINDS.index(k) for k in STRONG])


def reported() -> Column:
    """The spans of a row of scan_secrets that may be secrets: base and live ones, and strong ones whatever the count."""
    return F.concat("base", "live", F.filter(F.concat("shared", "repeated"), strong))
