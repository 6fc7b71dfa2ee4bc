r"""Personal data by weak supervision, in DataFrame functions alone.

Base spans come from one pattern for each kind (leftmost, not overlapping; a match that
fails its check is dropped).  Looser patterns add candidates in the rest of the text, among
them a fifth kind, ``secret``: a run of 20 to 200 letters and digits after a word such as token or
password, or with an issuer's prefix.  Three labelers vote on every candidate: its shape (regex), a gazetteer (area codes, mail domains,
address ranges, card issuers) and the words around it (context); a vote is for, against or
none.  Expectation-maximisation over the counts of the vote patterns estimates each
labeler's reliability and the share of true spans of each kind; its posteriors then train a
logistic classifier on votes, length and the variety of characters, which decides on the added candidates.  Base spans
always stay.

The counts of vote patterns are one aggregate of at most ``kinds * 27 * lengths * varieties`` rows; only these
reach the driver.  Positions are code points, end exclusive; they are prefix sums over
the pieces between matches, in blocks, so a text with very many matches costs no square.

The patterns are written so that the Java engine neither recurses nor retries: dots inside
mail domains and separators inside card numbers are first replaced, one character for
one, by a private character.

Null texts count as empty and have no spans; repeated rows give equal results; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order of the result: the base ones, then the one that only candidates have.
ALL_KINDS = (*KINDS, "secret")
#: How issued keys begin.
_ISSUED = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|ghs_|ghu_|github_pat_|glpat-|sk-|sk_live_|sk_test_|xoxb-|xoxp-|eyJ|hf_|npm_)"
_JOIN, _FREE = "\ue002", "\ue003"
#: The base patterns, over the prepared text of each kind.
PATTERNS = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+{_JOIN}-]))[A-Za-z0-9._%+{_JOIN}-]++@[A-Za-z0-9-]++{_JOIN}[A-Za-z0-9{_JOIN}-]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{_JOIN}]*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns of added candidates, those that overlap a base span are dropped.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(](?:dot|DOT)[\])] ?|\.)[A-Za-z]{2,24}+",
    "phone": r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z.-])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}+",
}
SHAPE = {
    "email": r"^[A-Za-z0-9._%+-]{2,64}@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}$",
    "ip": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$",
    "card": r"^[0-9]{4}([ -]?[0-9]{4}){3}$",
    "secret": r"^[0-9a-f]{32,}$|^[0-9A-F]{32,}$|^(?=[^0-9]*[0-9])(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z]).{20,}$",
    "phone": r"^\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}$|^\+[0-9]{1,3}[ .-]?[0-9() .-]{7,14}$|^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$",
}
#: Gazetteers as patterns: (for, against).
GAZETTEER = {
    "email": (r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$", r"(?i)\.(?:png|jpg|gif|js|css|html?)$"),
    "ip": (r"^(?:10|127|169|172|192|1[0-9]{2}|2[0-4][0-9]|[2-9][0-9])\.", r"^0*[0-9]\.0*[0-9]\.0*[0-9]\."),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)", r"^(?:0|9)"),
    "secret": (_ISSUED, r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^(?:/[a-z0-9_-]+)+$"),
    "phone": (r"^\(?(?:\+1|\+44|\+49|\+33|\+34|[2-9][0-9]{2})", r"^\(?[01]{3}"),
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|address)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login)\b",
    "card": r"(?i)\b(?:card|visa|payment|credit|account)\b",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|bearer)",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|contact)\b",
}
_AGAINST = r"(?i)\b(?:version|section|figure|isbn|order|invoice|serial)\b"
_BLOCK = 512
_LENGTHS = (9, 14, 20)
_VARIETIES = (5, 10)
#: Letters and digits of a secret, at most.
_SECRET_LENGTH = 200


def _prefix(values: Column, start: Column) -> Column:
    return F.slice(F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), 2, 2**30)


def running_sum(values: Column) -> Column:
    """Inclusive prefix sums of an array of longs, in blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / _BLOCK).cast("int") - 1), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
    before = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, s: _prefix(b, s)))


_SPAN = "array<struct<start: long, end: long, text: string, left: string, right: string>>"


def _spans(gaps: str, found: str) -> Column:
    """Spans with their neighbourhoods, of the arrays of pieces between matches and of matches."""
    g, f = F.col(gaps), F.col(found)
    k = F.size(f)
    lens = F.zip_with(F.slice(g, 1, k), F.concat(F.array(F.lit(0).cast("long")), F.transform(F.slice(f, 1, k - 1), lambda x: F.length(x).cast("long"))), lambda a, b: F.length(a).cast("long") + b)
    around = F.arrays_zip(running_sum(lens).alias("s"), f.alias("f"), F.transform(F.slice(g, 1, k), lambda x: F.right(x, F.lit(40))).alias("l"), F.transform(F.slice(g, 2, k), lambda x: F.left(x, F.lit(24))).alias("r"))
    spans = F.transform(around, lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["f"])).alias("end"), x["f"].alias("text"), x["l"].alias("left"), x["r"].alias("right")))
    return F.when(k > 0, spans).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def _located(df: DataFrame, source: Column, pattern: str, may: Column, out: str) -> DataFrame:
    """df with the array `out` of the pattern's spans in `source`; `may` is a cheap condition without which there are none."""
    df = df.withColumn("_src", F.when(may, source))
    df = df.withColumn("_found", F.coalesce(F.regexp_extract_all("_src", F.lit(pattern), F.lit(0)), F.array().cast("array<string>")))
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, F.split("_src", pattern, -1)))
    return df.withColumn(out, _spans("_gaps", "_found")).drop("_src", "_found", "_gaps")


def _free(t: Column) -> Column:
    """t without the private character, of the same length."""
    return F.translate(t, _JOIN, _FREE)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


_BYTE = r"^0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2}|)$"


def base_spans(df: DataFrame) -> DataFrame:
    """df (with the column _t) and the base spans of each kind in columns _email, _ip, _card and _phone."""
    t = F.col("_t")
    some = t.rlike("[0-9]")
    df = _located(df, F.regexp_replace(_free(t), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _JOIN), PATTERNS["email"], t.contains("@"), "_email")
    df = df.withColumn("_email", F.transform("_email", lambda x: x.withField("text", F.translate(x["text"], _JOIN, "."))))
    df = _located(df, t, PATTERNS["ip"], t.rlike(r"[0-9]\.[0-9]"), "_ip")
    df = df.withColumn("_ip", F.filter("_ip", lambda x: F.forall(F.split(x["text"], r"\."), lambda p: p.rlike(_BYTE))))
    df = _located(df, F.regexp_replace(_free(t), r"(?<=[0-9])[\x20-](?=[0-9])", _JOIN), PATTERNS["card"], some, "_card")
    df = df.withColumn("_card", F.filter("_card", lambda x: F.length(_digits(x["text"])).between(16, 19) & F.call_function("luhn_check", _digits(x["text"]))))
    df = _located(df, t, PATTERNS["phone"], t.contains("+"), "_phone")
    return df.withColumn("_phone", F.filter("_phone", lambda x: F.length(_digits(x["text"])).between(8, 15)))


def _overlaps(x: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    hit = F.lit(False)
    for k in kinds:
        hit = hit | F.exists(f"_{k}", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    return hit


def _vote(x: Column, kind: str) -> tuple[Column, Column, Column]:
    body, around = x["text"], F.concat_ws(" ", x["left"], x["right"])
    shape = F.when(body.rlike(SHAPE[kind]), 1).otherwise(-1)
    yes, no = GAZETTEER[kind]
    listed = F.when(body.rlike(no), -1).when(body.rlike(yes), 1).otherwise(0)
    context = F.when(x["left"].rlike(_AGAINST), -1).when(around.rlike(CUES[kind]), 1).otherwise(0)
    return shape, listed, context


def _labelled(column: str, kind: str, base: bool) -> Column:
    """Candidates of a kind with the key of their votes and length."""

    def one(x: Column) -> Column:
        votes = _vote(x, kind)
        n = F.length(x["text"])
        size = F.when(n <= _LENGTHS[0], 0).when(n <= _LENGTHS[1], 1).when(n <= _LENGTHS[2], 2).otherwise(3)
        different = F.size(F.array_distinct(F.split(x["text"], "")))
        variety = F.when(different <= _VARIETIES[0], 0).when(different <= _VARIETIES[1], 1).otherwise(2)
        key = F.concat_ws("|", F.lit(kind), *(v.cast("string") for v in votes), size.cast("string"), variety.cast("string"))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), key.alias("key"))

    return F.transform(column, one)


def _secret(x: Column) -> Column:
    """Whether a run may be a secret: letters and digits, not too long, after a cue or issued."""
    mixed = x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]") & (F.length(x["text"]) <= _SECRET_LENGTH)
    return mixed & (x["left"].rlike(CUES["secret"]) | x["text"].rlike(_ISSUED))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base spans in _base, and all candidates with vote keys in _all, of every row of docs."""
    t = F.coalesce(F.col("text"), F.lit(""))
    df = base_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("_t")))
    some = {"email": F.col("_t").rlike(r"(?i)[\[(]at[\])]"), "phone": F.col("_t").rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"), "card": F.col("_t").rlike(r"[0-9]{4}\.[0-9]{4}\."), "secret": F.col("_t").rlike("[A-Za-z0-9_+/-]{20,}+")}
    for k, pattern in LOOSE.items():
        df = _located(df, F.col("_t"), pattern, some[k], f"_more_{k}")
        df = df.withColumn(f"_more_{k}", F.filter(f"_more_{k}", lambda x: ~_overlaps(x) & (_secret(x) if k == "secret" else F.lit(True))))
    base = F.concat(*(_labelled(f"_{k}", k, True) for k in KINDS))
    more = F.concat(*(_labelled(f"_more_{k}", k, False) for k in LOOSE))
    return df.select("doc_id", base.alias("_base"), more.alias("_more"))


def estimate(counts: dict[str, int], rounds: int = 30) -> tuple[dict[str, float], dict[str, dict]]:
    """EM over the counts of keys (kind|shape|listed|context|size|variety): the posterior of each key, and each kind's prior and labeler reliabilities."""
    posterior: dict[str, float] = {}
    models = {}
    for kind in sorted({k.split("|")[0] for k in counts}):
        keys = [k for k in sorted(counts) if k.startswith(f"{kind}|")]
        votes = {k: [int(v) for v in k.split("|")[1:4]] for k in keys}
        prior, good = 0.7, [0.8, 0.7, 0.7]
        for _ in range(rounds):
            for k in keys:
                odds = math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes[k], good, strict=True))
                posterior[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            n = sum(counts[k] for k in keys)
            prior = min(0.98, max(0.02, (sum(counts[k] * posterior[k] for k in keys) + 1) / (n + 2)))
            for j in range(3):
                cast = [k for k in keys if votes[k][j]]
                agree = sum(counts[k] * (posterior[k] if votes[k][j] > 0 else 1 - posterior[k]) for k in cast)
                good[j] = min(0.98, max(0.52, (agree + 3) / (sum(counts[k] for k in cast) + 4)))
        models[kind] = {"prior": prior, "reliability": dict(zip(("shape", "listed", "context"), good, strict=True))}
    return posterior, models


def train(counts: dict[str, int], posterior: dict[str, float], rounds: int = 300, rate: float = 0.5) -> dict[str, float]:
    """The final span classifier: a logistic model on votes, length and variety, trained on the posteriors; its probability of each key."""

    def inputs(key: str) -> dict[str, float]:
        named = zip(("kind", "shape", "listed", "context", "size", "variety"), key.split("|"), strict=False)
        return {"one": 1.0, **{f"{name}={value}": 1.0 for name, value in named}}

    w: dict[str, float] = {}
    total = sum(counts.values()) or 1
    out = {}
    for step in range(rounds + 1):
        slope: dict[str, float] = {}
        for k, n in counts.items():
            x = inputs(k)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.get(f, 0.0) * v for f, v in x.items())))))
            out[k] = p
            for f, v in x.items():
                slope[f] = slope.get(f, 0.0) + n * (p - posterior[k]) * v / total
        if step < rounds:
            for f, g in slope.items():
                w[f] = w.get(f, 0.0) * 0.9999 - rate * g
    return out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def detect(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """doc_id, the numbers of base spans by kind, base_sha256, spans (joined), n_added (spans beside the base ones), n_secret, private (whether there is any span), found (array of kind, start, end, base and probability) of every row of docs."""
    rows = table(candidates(docs), "pii")
    both = rows.select(F.explode(F.concat("_base", "_more")["key"]).alias("key"))
    counts = {r.key: r.n for r in both.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior, _ = estimate(counts)
    sure = train(counts, posterior)
    known = F.create_map(*(c for k in sorted(sure) for c in (F.lit(k), F.lit(sure[k])))) if sure else F.lit(None).cast("map<string, double>")
    scored = F.transform(F.concat("_base", "_more"), lambda x: x.withField("p", F.coalesce(F.element_at(known, x["key"]), F.lit(0.0))))
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(F.element_at(F.create_map(*(c for i, k in enumerate(ALL_KINDS) for c in (F.lit(k), F.lit(i)))), x["kind"]).alias("k"), x["start"].alias("s"), x.alias("x")))), lambda y: y["x"])
    rows = rows.withColumn("_kept", order(F.filter(scored, lambda x: x["base"] | (x["p"] >= accept))))
    is_kind = lambda k: lambda x: x["kind"] == k
    n = [F.size(F.filter("_base", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *n, F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_kept")).alias("spans"), F.size(F.filter("_kept", lambda x: ~x["base"])).cast("long").alias("n_added"), F.size(F.filter("_kept", is_kind("secret"))).cast("long").alias("n_secret"), (F.size("_kept") > 0).alias("private"), F.col("_kept").alias("found"))
