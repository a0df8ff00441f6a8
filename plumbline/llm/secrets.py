"""Secret scans that weigh each candidate by who else has it.

One Arrow pass over the texts finds the base spans (assignments, access keys, long hex) and further shapes (key blocks,
signed web tokens, prefixed service keys). Candidate values are hashed, and the corpus says for each hash in how many
distinct repositories and by how many distinct owners it is held: a value in many repositories or of many owners is a
copied example, one in few and of few is live-looking. The value of a key block is the key in it, not its first line.
Only hashes, owners and repositories are shuffled, never texts; counts of distinct owners come from two nested groupings
with partial aggregation, so that a hot value or owner meets in no task.

Both bounds are absolute. A credential belongs to one owner (and perhaps a mirror), however many owners the corpus has,
so the number of owners that tells an example does not grow with theirs; repositories are bounded beside owners because
one owner may hold an example in many.

Base spans always stay. The further shapes add a span only if the value is held in few repositories and by few owners,
and has the spread of characters of a random key. Nulls: a null text is empty; a null owner or repository counts as one
of its own. Repeated rows are scanned one by one and owned once. Patterns scan a run of characters once, so that a text
of any length takes time in proportion; names of key blocks longer than 30 letters are not known.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, steps, table

#: Fixed values of the contract: the kinds in order, their patterns and their least lengths.
KINDS = ("assign", "access", "hex")
_ANY_CASE = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile("(" + "|".join(map(_ANY_CASE, ("password", "passwd", "secret", "token"))) + "|" + _ANY_CASE("api") + "_?" + _ANY_CASE("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # the runs of [0-9a-f]+ with 24 characters or more
#: Further shapes: kind and pattern; the value is the whole match, and for key blocks (see ``blocks``) the key's body.
FURTHER = (
    ("block", re.compile(r"-----(BEGIN|END) [A-Z ]{0,30}PRIVATE KEY-----")),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+")),
    ("service", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})\b")),
)
#: What may stand between the lines of a key: white space, escaped line ends, quotes and comment marks.
_GAP = r"""(?:\\+[nrt]|[\s"'>#*|,;])"""
#: The body of a key without an END line: header fields, long base64 lines, and a short last one.
_BODY = re.compile(rf"(?:{_GAP}*+(?:Proc-Type|DEK-Info|Version|Comment|Charset):(?:(?!-----)[^\n\\])*+)*+(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})++(?:(?:\\+[nr]|[\r\n]){_GAP}*+[A-Za-z0-9+/]{{1,15}}+={{0,2}}(?=[\x20\t]*+(?:\\+[nr]|[\r\n\"',;]|\Z)))?")
_LONG_RUN, _NOT_KEY = re.compile("[A-Za-z0-9+/=]{16,}"), re.compile(r"\\+[nrt]|[^A-Za-z0-9+/=]")
#: A value held by this many owners or more is a copied example.
COPIED_OWNERS = 3
#: So is one that this many repositories hold, though their owners are few.
COPIED_REPOS = 25
#: Bits a character that a value must have to look random.
LEAST_BITS = 3.0

_SPANS = "spans array<struct<kind:string,start:int,end:int,value_start:int,base:boolean,digest:binary,random:boolean>>"


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the base kinds, by start and then kind as listed."""
    found = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def key_of(body: str) -> str:
    """The base64 characters of a key's body, however its lines are broken, escaped or indented."""
    return _NOT_KEY.sub("", body)


def blocks(text: str) -> list[tuple[str, int, int, int, str]]:
    """Key blocks: from BEGIN to the end of the END line, or where that is missing, of the key's body.

    What stands up to an END line is a key if most of it is in long base64 runs; else (prose that names both lines) the
    block ends with the base64 that follows BEGIN. The value is the key, and the BEGIN line where no key follows.
    """
    marks, found = list(FURTHER[0][1].finditer(text)), []
    for m, after in zip(marks, [*marks[1:], None], strict=True):
        if m[1] == "BEGIN":
            start, end = m.end(), m.end()
            closed = text[start : after.start()] if after and after[1] == "END" else ""
            key = key_of(closed)
            if key and 2 * sum(map(len, _LONG_RUN.findall(closed))) >= len(key):
                end = after.end()
            else:
                body = _BODY.match(text, start)
                key, end = (key_of(body[0]), body.end()) if body else ("", end)
            found.append(("block", m.start(), end, start if key else m.start(), key or m[0]))
    return found


def further_spans(text: str) -> list[tuple[str, int, int, int, str]]:
    """(kind, start, end, start of the value, value) of the further shapes."""
    found = blocks(text) if "PRIVATE KEY" in text else []
    return found + [(kind, m.start(), m.end(), m.start(), m[0]) for kind, p in FURTHER[1:] for m in p.finditer(text)]


def bits(value: str) -> float:
    """Shannon entropy of the characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _scan(batches, id_col: str, owner_col: str, repo_col: str, text_col: str):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("base", pa.bool_()), ("digest", pa.binary()), ("random", pa.bool_())]))
    for batch in batches:
        for part, _, _ in steps(batch, text_col):
            rows = []
            for text in part.column(text_col).to_pylist():
                text, spans = text or "", []
                for base, found in ((True, [(*s, text[s[3] : s[2]]) for s in base_spans(text)]), (False, further_spans(text))):
                    for k, s, e, v, value in found:
                        spans.append({"kind": k, "start": s, "end": e, "value_start": v, "base": base, "digest": hashlib.sha256(value.encode()).digest()[:16], "random": bits(value) >= LEAST_BITS or k == "block"})
                rows.append(spans)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (id_col, owner_col, repo_col)), pa.array(rows, kind)], names=["id", "owner", "repo", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", repo_col: str | None = None, text_col: str = "text", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """One row per document: id, spans (kind, start, end, value_start, base, digest, n_owners, n_repos, live).

    ``repo_col`` names the repository that a document belongs to; by default each document is one of its own.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col or id_col).cast("string").alias("repo"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    scanned = cut(rows.mapInArrow(lambda b: _scan(b, "id", "owner", "repo", "text"), f"id {kind}, owner string, repo string, {_SPANS}").withColumn("row", F.monotonically_increasing_id()))
    held = scanned.filter(F.size("spans") > 0).select("row", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"), F.explode("spans").alias("s"))
    values = held.select(F.col("s.digest").alias("digest"), "owner", "repo")
    # rows of a hot value fold into one per owner and repository first; both counts then need no set in memory
    # (both are cut: Spark splits a hot key of a join between plain shuffles only)
    owners = cut(values.groupBy("digest", "owner").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("n_owners")))
    repos = cut(values.groupBy("digest", "repo").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("n_repos")))
    s = "s."
    weighed = (
        held.withColumn("digest", F.col("s.digest")).join(owners, "digest").join(repos, "digest")
        .withColumn("live", (F.col("n_owners") < copied_owners) & (F.col("n_repos") < copied_repos) & F.col("s.random"))
        .filter(F.col("s.base") | F.col("live"))
        .select("row", F.struct(*(F.col(s + c).alias(c) for c in ("kind", "start", "end", "value_start", "base", "digest")), "n_owners", "n_repos", "live").alias("s"))
        .groupBy("row").agg(F.collect_list("s").alias("spans"))
    )
    joined = scanned.select("id", "row", F.size("spans").alias("n")).join(weighed, "row", "left")
    rank = lambda x: F.array_position(F.lit([*KINDS, *(k for k, _ in FURTHER)]), x["kind"])
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise((rank(a) - rank(b)).cast("int"))
    return joined.select(F.col("id").alias(id_col), F.when(F.col("spans").isNull(), F.array()).otherwise(F.array_sort("spans", order)).alias("spans"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )
