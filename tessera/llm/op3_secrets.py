"""Secret scans by a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression; a Boolean trigram query is derived from it (trigrams.py):
one of several clauses, all trigrams of which a matching text must hold in lower case. The
index has a posting (trigram, row) for every row and every trigram that some rule asks for;
intersecting the postings of a clause is counting its trigrams by row. Candidates are verified
by the expression itself. A rule without mandatory trigrams ("hex") scans every text.

Rows are keyed by a hash of doc_id and text, so copies of a text under other ids don't meet; a
collision could only add candidates. Verification joins candidates to the texts, keys of many
equal rows dealt to several tasks.

Spans come from two passes of the expression over a candidate: its matches, and the gaps
between them; running sums of their lengths, by doubling steps, are the positions, in code
points.

Defined cases: null text is empty and has no spans; an empty text likewise; repeated rows
are scanned alike and each kept; an empty table gives no rows; extra columns are kept out
of the result unless asked for, and don't clash, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import HOT, hot_join, materialize
from tessera.llm.trigrams import query_of

#: kind: (regular expression, least length, group measured). The first three are the contract's.
RULES = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    "access": (r"AKIA[A-Z0-9]+", 20, 0),
    "hex": (r"[0-9a-f]+", 24, 0),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", 0, 0),
}
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def clauses(rules: dict = RULES) -> list[tuple[str, int, str, int]]:
    """(kind, clause, trigram, trigrams of the clause): the derived query of each rule that has mandatory trigrams."""
    asked = {kind: query_of(rule[0]) for kind, rule in rules.items()}
    return [(kind, i, g, len(c)) for kind, query in asked.items() if all(query) for i, c in enumerate(query) for g in sorted(c)]


def postings(rows: DataFrame, rules: dict = RULES) -> DataFrame:
    """_key, n (rows that have it) and the trigrams, of those that rules ask for, that its text holds."""
    grams = sorted({g for _, _, g, _ in clauses(rules)})
    low = rows.select("_key", F.lower("_text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    # no condition on the trigrams here: pushed below, it would lower-case each text once for each of them
    return materialize(low.select("_key", held.alias("grams")).groupBy("_key").agg(F.first("grams").alias("grams"), F.count("*").alias("n")), "secret-postings")


def candidates(index: DataFrame, rules: dict = RULES) -> DataFrame:
    """_key, n and _kinds, the rules of which all trigrams of some clause are held; without kinds only keys of many rows."""
    asked = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("clause"), F.lit(g).alias("gram"), F.lit(n).alias("need")) for k, c, g, n in clauses(rules)] or [F.struct(F.lit("").alias("kind"), F.lit(0).alias("clause"), F.lit("").alias("gram"), F.lit(1).alias("need"))])
    lists = index.select("_key", F.explode("grams").alias("gram"))
    met = lists.select("_key", F.explode(F.filter(asked, lambda r: r["gram"] == F.col("gram"))).alias("r")).groupBy("_key", "r.kind", "r.clause", "r.need").agg(F.count("*").alias("met")).where("met = need")
    kinds = met.groupBy("_key").agg(F.collect_set("kind").alias("_kinds"))
    return materialize(index.select("_key", "n").join(kinds, "_key", "left").where(F.col("_kinds").isNotNull() | (F.col("n") > HOT)), "secret-candidates")


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Each value merged (sum, greatest) with all before it: as many steps as the length has binary digits."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1)

    def shifted(acc: Column, step: Column) -> Column:
        return F.slice(F.concat(F.array_repeat(F.lit(0), F.pow(F.lit(2), step).cast("int")), acc), F.lit(1), F.size(acc))

    return F.aggregate(steps, values, lambda acc, step: F.zip_with(acc, shifted(acc, step), merge))


def spans(text: Column, kind: str, rules: dict = RULES) -> Column:
    """SPANS of a rule's matches, in code points."""
    pattern, least, group = rules[kind]
    rank = list(rules).index(kind)
    if kind == "hex":
        pattern = r"[0-9a-f]{24,}"  # runs are maximal, so those that fail drop out alike
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    measured = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)) if least and group else whole
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    ends = running(F.zip_with(gaps, whole, lambda g, m: F.length(g) + F.length(m)), lambda a, b: a + b)
    rows = F.filter(F.arrays_zip(ends.alias("end"), whole.alias("whole"), measured.alias("measured")), lambda r: F.length(r["measured"]) >= least)
    found = F.transform(rows, lambda r: F.struct((r["end"] - F.length(r["whole"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), r["end"].alias("end")))
    return F.when(F.size(whole) > 0, found).otherwise(F.array().cast(SPANS))


def find(docs: DataFrame, keep: list[str], rules: dict = RULES) -> DataFrame:
    """_row (the columns keep), _text (null as empty), _null, and _spans: every verified span of every row, by start, then kind."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), text.alias("_text"), F.col("text").isNull().alias("_null"), F.xxhash64("doc_id", text).alias("_key"))
    found = hot_join(rows, candidates(postings(rows, rules), rules), ["_key"], "n", "left")
    indexed = {k for k, *_ in clauses(rules)}
    each = [F.when(F.array_contains("_kinds", k), spans(F.col("_text"), k, rules)).otherwise(F.array().cast(SPANS)) if k in indexed else spans(F.col("_text"), k, rules) for k in rules]
    return found.select("_row", "_text", "_null", F.array_sort(F.flatten(F.array(*each))).alias("_spans"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find(docs, ["doc_id"]).select("_row.doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with the words of every span replaced by mark and n_chars counted anew; the other columns as they are."""
    ends = running(F.transform("_spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    before = F.concat(F.array(F.lit(0)), ends)
    # a span inside former ones adds nothing; one that goes on beyond them adds a mark
    pieces = F.zip_with("_spans", F.slice(before, F.lit(1), F.size("_spans")), lambda s, at: F.when(s["end"] <= at, F.lit("")).otherwise(F.concat(F.substr("_text", at + 1, F.greatest(s["start"] - at, F.lit(0))), F.lit(mark))))
    hit = F.size("_spans") > 0
    clean = F.when(hit, F.concat(F.array_join(pieces, ""), F.substr("_text", F.element_at(before, -1) + 1, F.length("_text")))).otherwise(F.col("_text"))
    others = [c for c in docs.columns if c != "text"]
    found = find(docs, others).select("_row", F.when(~F.col("_null"), clean).alias("_clean"), hit.alias("_hit"))
    own = {c: F.col(f"_row.`{c}`") for c in others} | {"text": F.col("_clean")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("_hit"), F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return found.select(*[own[c].alias(c) for c in docs.columns])
