"""Personal data by patterns and by weak supervision, in DataFrame operations only.

*Base spans* (email, ip, card, phone) come from patterns with checks. *Added spans* (kind ``secret``: keys, tokens,
passwords) come from four labelers that vote on candidate words: a key pattern, a gazetteer of credential words before
the candidate, the separator before it, and its mix of characters. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is without any labels; the posteriors then train a naive-Bayes classifier
over features of the candidate, which decides on the spans. Votes and features take few values, so only their counts
(a bounded table) reach the driver, and the fitted classifier is a plain column expression.

Patterns use possessive repeats, and begin only where a run of their characters begins or the last match ended
(``\\G``), so a text is read once and long runs neither backtrack nor overflow the stack; the matches are the same.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import let, running, spans

from .common import table, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CANDIDATE = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{12,}+"
# Credential words that make the gazetteer labeler vote.
GAZETTEER = ("password", "passwd", "passphrase", "pwd", "pin", "token", "secret", "apikey", "api_key", "api-key", "access_key", "private_key", "credential", "auth", "bearer", "login", "clave", "contraseña", "passwort", "kennwort", "motdepasse")
CONTEXT = 32
ROUNDS = 40


_NONE = "cast(array() as array<struct<start:bigint,end:bigint,text:string,before:string>>)"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    turned = F.reverse(_digits(x))

    def add(total: Column, i: Column) -> Column:
        d = turned.substr(i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) % 10 == 0


_CHECKS = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(F.concat(F.lit("0"), p), F.lit(3)).cast("int") <= 255)),
    "card": lambda x: F.length(_digits(x)).between(12, 19) & _luhn(x),
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
}


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) and an array column of (start, end, text, before) for each base kind."""
    out = docs
    for kind in BASE:
        found = spans(F.col("text"), PATTERNS[kind])
        if _NEEDS[kind]:
            found = F.when(F.col("text").contains(_NEEDS[kind]), found).otherwise(F.expr(_NONE))
        out = out.withColumn(kind, found)

    def checked(kind: str) -> Column:
        return F.filter(kind, lambda s: _CHECKS[kind](s["text"])).alias(kind)

    return out.select(*docs.columns, *[checked(kind) for kind in BASE])


def _votes(x: Column) -> dict[str, Column]:
    """1 for a secret, 0 against it, -1 to abstain."""
    word, before = x["text"], x["before"]
    digits = F.length(_digits(word)) / F.length(word)
    named = F.lower(before).rlike("(?:" + "|".join(GAZETTEER) + r")[^A-Za-z0-9]{0,6}\z")
    return {
        "pattern": F.when(word.rlike(r"\A(?:AKIA[0-9A-Z]{16}|[0-9a-f]{16,}|[0-9A-F]{24,}|gh[pousr][A-Za-z0-9]{30,})\z") & ~word.rlike(r"\A[0-9]+\z"), 1).when(word.rlike(r"\A[0-9]+\z"), 0).otherwise(-1),
        "gazetteer": F.when(named, 1).otherwise(-1),
        "context": F.when(before.rlike(r"[=:\"'`]\s{0,2}\z"), 1).when(before.rlike(r"[a-z,.] \z"), 0).otherwise(-1),
        "shape": F.when(digits.between(0.05, 0.85), 1).otherwise(0),
    }


def _features(x: Column) -> dict[str, Column]:
    word, before = x["text"], x["before"]
    digits = F.length(_digits(word)) / F.length(word)
    return {
        "size": F.when(F.length(word) < 16, 0).when(F.length(word) < 20, 1).when(F.length(word) < 32, 2).otherwise(3),
        "letters": F.when(word.rlike(r"\A[0-9]+\z"), 0).when(word.rlike(r"\A[0-9a-f]+\z"), 1).when(word.rlike(r"\A[0-9A-Z]+\z"), 2).when(word.rlike("[a-z]") & word.rlike("[A-Z]"), 3).otherwise(4),
        "digits": F.floor(digits * 4).cast("int"),
        "named": F.lower(before).rlike("(?:" + "|".join(GAZETTEER) + r")").cast("int"),
        "led": F.when(before.rlike(r"[=:\"'`]\s{0,2}\z"), 2).when(before.rlike(r"\s\z"), 1).otherwise(0),
    }


def expectation_maximisation(patterns: dict[tuple[int, ...], float], rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], list[tuple[float, float]]]:
    """Posterior of "secret" for each pattern of votes, and each labeler's (hit rate, false-alarm rate).

    Starts from the majority vote; a labeler's abstentions tell nothing. Counts get one added vote either way.
    """
    width = len(next(iter(patterns), ()))
    post = {p: (1 + sum(v == 1 for v in p)) / (2 + sum(v >= 0 for v in p)) for p in patterns}
    rates = [(0.5, 0.5)] * width
    for _ in range(rounds):
        total = sum(patterns.values())
        prior = (1 + sum(n * post[p] for p, n in patterns.items())) / (2 + total)
        rates = []
        for k in range(width):
            cast = [(n, post[p], p[k]) for p, n in patterns.items() if p[k] >= 0]
            hit = (2 + sum(n * q for n, q, v in cast if v)) / (3 + sum(n * q for n, q, _ in cast))
            alarm = (1 + sum(n * (1 - q) for n, q, v in cast if v)) / (3 + sum(n * (1 - q) for n, q, _ in cast))
            rates.append((hit, alarm))
        for p in patterns:
            odds = math.log(prior / (1 - prior))
            for v, (hit, alarm) in zip(p, rates):
                if v >= 0:
                    odds += math.log(hit / alarm if v else (1 - hit) / (1 - alarm))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, rates


def fit(docs: DataFrame) -> dict:
    """The span classifier: log-odds weights of each feature value and a bias, from all candidates of ``docs``."""
    x = F.col("x")
    votes, features = _votes(x), _features(x)
    found = docs.select(F.explode(spans(F.col("text"), CANDIDATE, CONTEXT)).alias("x")).select(*[v.alias(f"v_{k}") for k, v in votes.items()], *[v.alias(f"f_{k}") for k, v in features.items()])
    columns = found.columns
    counts = found.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3**4 vote patterns times 4*5*5*2*3 feature values
    patterns: dict[tuple[int, ...], float] = defaultdict(float)
    for r in counts:
        patterns[tuple(r[f"v_{k}"] for k in votes)] += r["n"]
    post, rates = expectation_maximisation(patterns)
    yes, no = defaultdict(float), defaultdict(float)
    for r in counts:
        q = post[tuple(r[f"v_{k}"] for k in votes)]
        for k in features:
            yes[k, r[f"f_{k}"]] += r["n"] * q
            no[k, r[f"f_{k}"]] += r["n"] * (1 - q)
        yes[None] += r["n"] * q
        no[None] += r["n"] * (1 - q)
    values = {key for key in [*yes, *no] if key is not None}
    weights = {key: math.log((yes[key] + 0.5) / (yes[None] + 1)) - math.log((no[key] + 0.5) / (no[None] + 1)) for key in values}
    return {"bias": math.log((yes[None] + 1) / (no[None] + 1)), "weights": weights, "rates": dict(zip(votes, rates))}


def _is_secret(x: Column, model: dict) -> Column:
    score = F.lit(model["bias"])
    for name, column in _features(x).items():
        term = F.lit(0.0)
        for (k, value), weight in sorted((key, w) for key, w in model["weights"].items() if key[0] == name):
            term = F.when(column == value, weight).otherwise(term)
        score = score + term
    return score > 0


def find(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row with doc_id, text, the columns to carry, and spans; spans are (start, kind number, end, kind), ordered, over all kinds.

    ``model`` comes from :func:`fit`, by default over these very documents. Null texts count as empty and have no
    spans; null ids and repeated rows are rows like others; an empty table gives an empty one. Added spans that overlap a
    base span are left out; base spans always stay. Columns to carry keep any name but ``doc_id``, ``text`` and
    ``spans``, which raise a ValueError; columns not carried play no part. A text of any length is worked on whole, in
    time that hardly grows faster than it.
    """
    if clash := {"doc_id", "text", "spans"} & set(carry):
        raise ValueError(f"names of result columns: {sorted(clash)}")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("_")]).alias("carried"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts(rows, carry=("carried",))
    model = model or fit(rows)
    based = base_spans(rows).withColumn("candidate", F.filter(spans(F.col("text"), CANDIDATE, CONTEXT), lambda s: _is_secret(s, model)))

    def tagged(column: Column, number: int) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("number"), s["end"].alias("end"), F.lit(KINDS[number]).alias("kind")))

    base = F.concat(*[tagged(F.col(kind), i) for i, kind in enumerate(BASE)])
    every = F.array_sort(F.concat(base, tagged(F.col("candidate"), len(BASE))))
    found = F.when(F.size("candidate") == 0, F.array_sort(base)).otherwise(let(every, _free))
    return based.select("doc_id", "text", *[F.col(f"carried.`{c}`") for c in carry], found.alias("spans"))


def _free(found: Column) -> Column:
    """Ordered spans without added ones that overlap base spans.

    Base spans that begin earlier reach no further than their greatest end so far; of those that begin later the next
    span is the first, since added spans don't overlap each other.
    """
    added = lambda s: s["number"] == len(BASE)
    ends = running(F.transform(found, lambda s: F.when(added(s), F.lit(-1).cast("long")).otherwise(s["end"])), lambda a, b: F.greatest(a, b))

    def stays(reach: Column) -> Column:
        def keeps(s: Column, i: Column) -> Column:
            following = F.get(found, i + 1)
            clear = (F.get(reach, i) <= s["start"]) & (following.isNull() | added(following) | (following["start"] >= s["end"]))
            return F.when(~added(s) | clear, s)

        return F.filter(F.transform(found, keeps), lambda s: s.isNotNull())

    return let(ends, stays)


def redact(found: DataFrame) -> DataFrame:
    """The rows of :func:`find`, without spans: each run of overlapping spans replaced by the kind of its first, in angle brackets.

    The text is cut in a form of four bytes a character, so a cut costs no search from the beginning.
    """
    text, wide = F.col("text"), F.encode("text", "UTF-32")

    def cut(data: Column, start: Column, end: Column) -> Column:
        return F.decode(F.substring(data, (start * 4 + 1).cast("int"), ((end - start) * 4).cast("int")), "UTF-32")

    def replaced(data: Column, ends: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(ends, i - 1))
            return F.when(s["start"] >= before, F.concat(cut(data, before, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))

        rest = cut(data, F.element_at(ends, -1), F.char_length(text))
        return F.concat(F.array_join(F.transform("spans", piece), ""), rest)

    ends = running(F.transform("spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    done = let(ends, lambda e: let(wide, lambda data: replaced(data, e)))
    return found.withColumn("text", F.when(F.size("spans") == 0, text).otherwise(done)).drop("spans")


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents")).select("doc_id", "spans")

    def of(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["number"] == number)).cast("long")

    count = [of(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    return found.select("doc_id", *count, F.sha2(_line(base).cast("binary"), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))
