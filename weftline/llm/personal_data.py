"""Operator 8, personal data by weak supervision. DataFrame functions only.

Base spans are the matches of four patterns that pass their checks. Looser patterns add
candidates of the same kinds and of secrets (keys, tokens, passwords), which have no base
pattern. Labelers vote on every candidate: a strict pattern of its canonical form, the usual
shape, a gazetteer (top-level domains, address ranges, issuers, calling codes, key prefixes), the
words before and after it, and a checksum (Luhn, number of digits, entropy of a secret); each
says 1, -1 or abstains with 0. Counts of the distinct vote patterns, whose number is bounded by
3**5 votes for each kind and length class, go to the driver, where expectation-maximisation
estimates each labeler's reliability for each kind without labels. Its posteriors train a
logistic span classifier on votes, kind and length, which is applied as a column expression.
Base spans always stay; loose candidates that the classifier accepts and that overlap no base
span are added, in the order of the kinds, where they overlap none added before.

The patterns say the same as their plain forms but start only where a match can start and
use possessive loops, so that long runs cost neither quadratic time nor deep stacks; matches are
folded in chunks, so that a text of very many matches costs no square of them.

Defined results: null and empty text have no spans; repeated rows are searched one by one;
null doc_ids stay null; other columns are ignored by find() and kept by redact(), whatever
their names; an empty table gives no rows. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written
from .native import let

KINDS = ("email", "ip", "card", "phone")
#: Kinds of loose candidates; secrets have no base pattern.
ALL_KINDS = (*KINDS, "secret")
LABELERS = ("regex", "shape", "gazetteer", "context", "checksum")

# The base patterns.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern to be worth running.
GATE = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
LOOSE = {
    "email": rf"[{_LOCAL}]{{1,64}}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{{1,63}}){{1,4}}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9._/])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+.()-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}",
}
LOOSE_GATE = {"email": r"[(\[]at[)\]]", "ip": r"(?::[0-9A-Fa-f]{1,4}){7}", "card": r"[0-9]{4}[._/][0-9]{4}[._/]", "phone": r"[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}", "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16}"}
CANONICAL = {
    "email": r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}+\.){1,10}+[A-Za-z]{2,24}$",
    "ip": r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$|^(?:[0-9A-Fa-f]{1,4}(?::|$)){8}$",
    "card": r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14})$",
    "phone": r"^(?:\+?1)?[2-9][0-9]{2}[2-9][0-9]{6}$|^\+[2-9][0-9]{8,13}$",
    "secret": r"^(?:A(?:KIA|SIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}|glpat-[A-Za-z0-9_-]{20})$",
}
SHAPE = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,24}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$|:",
    "card": r"^[0-9]{4}([\x20._/-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^3[0-9]{13,14}$",
    "phone": r"^(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}$",
    "secret": r"^(?:[0-9a-f]++|[0-9A-F]++|[0-9A-Z]++|(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])[A-Za-z0-9+/]++={0,2})$",
}
# Gazetteers as patterns: common domains, address ranges, issuers' first digits, calling codes, key prefixes.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]]\x20?)(?:com|org|net|edu|gov|mil|int|info|biz|name|io|co|ai|app|dev|de|fr|es|it|uk|us|eu|ch|at|nl|be|pl|se|no|dk|fi|pt|cz|gr|ie|ru|ua|cn|jp|kr|in|br|mx|ar|cl|ca|au|nz|za)$",
    "ip": r"^(?!0*(?:0|127|255)\.)0*(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.|^[23][0-9A-Fa-f]{3}:",
    "card": r"^[2-6]",
    "phone": r"^\+(?:1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[058][0-9]|9[0-58]|9[679][0-9])|^\(?[2-9][0-9]{2}",
    "secret": r"^(?:A(?:KIA|SIA|GPA|IDA|ROA)|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k[_-]|AIza|ya29|eyJ|npm_|SG\.|pk_|hf_)",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|client|adresse)\b",
    "card": r"(?i)\b(?:card|credit|visa|mastercard|amex|debit|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|fax|whatsapp|telefon|teléfono)\b",
    "secret": r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credentials?|contraseña|passwort)[^A-Za-z0-9]{0,6}$",
}
AGAINST = r"(?i)\b(?:isbn|issn|order|invoice|version|figure|table|section|page|serial|part|build|release)\b"
AGAINST_SECRET = r"(?i)\b(?:commit|sha-?1|sha-?256|md5|hash|uuid|guid|checksum|digest|etag|revision|href|src|https?|doi|isbn)\b|/$"
AFTER = r"(?i)^[^A-Za-z0-9]{0,3}(?:pages?|items?|units?|pieces|euros?|dollars?|percent)\b"
#: Bits a character from which a secret counts as random, and under which as not.
RANDOM, PLAIN = 2.8, 2.2
#: Characters of context on either side; matches folded at a time.
BEFORE, CHUNK = 40, 256

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_SPAN = "array<struct<kind:string,start:int,end:int,strict:boolean,votes:array<int>,size:int>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _passes(kind: str, text: Column) -> Column:
    n = F.char_length(_digits(text))
    return {
        "email": F.lit(True),
        "ip": text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": n.between(13, 19) & F.call_function("luhn_check", _digits(text)),
        "phone": n.between(9, 15),
    }[kind]


def _chunks(items: Column) -> Column:
    """An array as an array of arrays of CHUNK elements."""
    cut = lambda i: F.slice(items, i * CHUNK + 1, CHUNK)
    return F.when(F.size(items) == 0, F.array(items)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), cut))


def _found(text: Column, pattern: str) -> Column:
    """Matches in order: start, end, text, and the characters before and after it (to the next match on either side)."""
    hit = "struct<start:int,end:int,text:string,before:string,after:string>"
    inner, outer = f"struct<at:int,out:array<{hit}>>", f"struct<at:int,out:array<array<{hit}>>>"

    def pairs(gaps: Column) -> Column:
        gap = lambda i: F.get(gaps, i)
        return F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda x, i: F.struct(F.char_length(gap(i)).alias("gap"), F.right(gap(i), F.lit(BEFORE)).alias("before"), F.left(gap(i + 1), F.lit(BEFORE)).alias("after"), x.alias("text")),
        )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["text"])
        one = F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")).cast(inner)

    def chunk(acc: Column, items: Column) -> Column:
        own = F.aggregate(items, F.struct(acc["at"].alias("at"), F.array().alias("out")).cast(inner), step)
        return let(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")).cast(outer))

    empty = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(outer)
    all_pairs = let(F.split(text, pattern, -1), pairs)
    return F.aggregate(let(all_pairs, _chunks), empty, chunk, lambda acc: F.flatten(acc["out"]))


def _entropy(text: Column) -> Column:
    """Bits a character."""

    def of(chars: Column) -> Column:
        def share(c: Column) -> Column:
            return F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)

        return F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), of)


def _votes(kind: str, hit: Column) -> Column:
    """A vote of each of LABELERS."""
    text, before, after = hit["text"], hit["before"], hit["after"]
    yes_no = lambda c: F.when(c, 1).otherwise(-1)
    against = before.rlike(AGAINST_SECRET if kind == "secret" else AGAINST) | after.rlike(AFTER)
    context = F.when(before.rlike(CONTEXT[kind]), 1).when(against, -1).otherwise(0)
    gazetteer = yes_no(text.rlike(GAZETTEER[kind]))
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(text, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?(?:[(\[]dot[)\]]|\.)\x20?", ".")
        regex, checksum = yes_no(plain.rlike(CANONICAL[kind])), F.lit(0)
        gazetteer = yes_no(plain.rlike(GAZETTEER[kind]))
    elif kind == "ip":
        regex, checksum = yes_no(text.rlike(CANONICAL[kind])), F.lit(0)
    elif kind == "card":
        regex, checksum = yes_no(_digits(text).rlike(CANONICAL[kind])), yes_no(F.call_function("luhn_check", _digits(text)))
    elif kind == "phone":
        regex = yes_no(F.regexp_replace(text, r"[^0-9+]", "").rlike(CANONICAL[kind]))
        checksum = yes_no(F.char_length(_digits(text)).between(10, 13))
    else:
        regex, gazetteer = F.when(text.rlike(CANONICAL[kind]), 1).otherwise(0), F.when(text.rlike(GAZETTEER[kind]), 1).otherwise(0)
        checksum = let(_entropy(text), lambda bits: F.when(bits >= RANDOM, 1).when(bits < PLAIN, -1).otherwise(0))
    return F.array(regex, yes_no(text.rlike(SHAPE[kind])), gazetteer, context, checksum)


def _spans(text: Column, kind: str, strict: bool) -> Column:
    """Candidates of one kind as _SPAN."""
    pattern, gate = (BASE, GATE) if strict else (LOOSE, LOOSE_GATE)
    found = _found(text, pattern[kind])
    if strict:
        found = F.filter(found, lambda x: _passes(kind, x["text"]))
    size = lambda x: F.least(F.floor((x["end"] - x["start"]) / 6), F.lit(7)).cast("int")
    spans = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(strict).alias("strict"), _votes(kind, x).alias("votes"), size(x).alias("size")))
    return F.when(text.rlike(gate[kind]), spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def candidates(docs: DataFrame, keep: list[str], names: tuple[str, str]) -> DataFrame:
    """The columns keep of docs, and those named for base and loose spans with their votes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*(_spans(text, k, True) for k in KINDS))
    loose = F.concat(*(_spans(text, k, False) for k in ALL_KINDS))
    rows = docs.select(*keep, base.alias(names[0]), loose.alias(names[1]))
    free = F.filter(names[1], lambda x: ~F.exists(names[0], lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return rows.withColumn(names[1], F.when(F.size(names[1]) > 0, free).otherwise(F.col(names[1])))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> tuple[dict, dict]:
    """Two-class EM over (kind, votes, count): P(vote | class) by (kind, labeler, class), posterior by (kind, votes)."""
    post = {(k, v): 1 / (1 + math.exp(-1.5 * sum(v))) for k, v, _ in patterns}
    table: dict = {}
    for _ in range(rounds):
        weight = {(k, c): 1.0 for k in ALL_KINDS for c in (0, 1)}
        table = {(k, j, c): {-1: 1.0, 0: 1.0, 1: 1.0} for k in ALL_KINDS for j in range(len(LABELERS)) for c in (0, 1)}
        for k, v, n in patterns:
            for c in (0, 1):
                w = n * (post[k, v] if c else 1 - post[k, v])
                weight[k, c] += w
                for j, x in enumerate(v):
                    table[k, j, c][x] += w
        for key, votes in table.items():
            total = sum(votes.values())
            table[key] = {x: y / total for x, y in votes.items()}
        for k, v, _ in patterns:
            odds = math.log(weight[k, 1] / weight[k, 0]) + sum(math.log(table[k, j, 1][x] / table[k, j, 0][x]) for j, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return table, post


def _features(kind: str, votes: tuple[int, ...], size: int) -> list[float]:
    return [*(float(kind == k) for k in ALL_KINDS), *map(float, votes), size / 8]


def train(rows: list[tuple[str, tuple[int, ...], int, int]], rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights of the logistic span classifier from (kind, votes, size, count) rows labelled by EM."""
    merged: dict = {}
    for k, v, _, n in rows:
        merged[k, v] = merged.get((k, v), 0) + n
    _, post = reliabilities([(k, v, n) for (k, v), n in sorted(merged.items())])
    data = [(_features(k, v, s), post[k, v], math.log1p(n)) for k, v, s, n in sorted(rows)]
    total = sum(n for *_, n in data) or 1.0
    w = [0.0] * (len(ALL_KINDS) + len(LABELERS) + 1)
    for _ in range(rounds):
        slope = [decay * x for x in w]
        for x, y, n in data:
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for i, xi in enumerate(x):
                slope[i] += n * (p - y) * xi / total
        w = [a - rate * b for a, b in zip(w, slope, strict=True)]
    return w


def _model(rows: DataFrame, base: str, loose: str) -> list[float]:
    """Train on the counts of all candidates' vote patterns; their number is bounded."""
    spans = rows.where((F.size(base) > 0) | (F.size(loose) > 0)).select(F.explode(F.concat(base, loose)).alias("s"))
    counts = spans.groupBy("s.kind", "s.votes", "s.size").count().collect()
    return train([(r[0], tuple(r[1]), r[2], r[3]) for r in counts])


def _accepted(w: list[float], loose: str) -> Column:
    """The loose spans that the classifier accepts, each where no earlier one of them overlaps."""

    def score(x: Column) -> Column:
        s = w[-1] * x["size"] / 8.0
        for k, kind in enumerate(ALL_KINDS):
            s = s + F.when(x["kind"] == kind, F.lit(w[k])).otherwise(F.lit(0.0))
        for j in range(len(LABELERS)):
            s = s + w[len(ALL_KINDS) + j] * F.get(x["votes"], F.lit(j))
        return s

    def apart(good: Column) -> Column:
        before = lambda x, i: F.exists(F.slice(good, 1, i), lambda b: (b["kind"] != x["kind"]) & (x["start"] < b["end"]) & (b["start"] < x["end"]))
        several = F.size(F.array_distinct(F.transform(good, lambda x: x["kind"]))) > 1
        return F.when(several, F.filter(good, lambda x, i: ~before(x, i))).otherwise(good)

    return let(F.filter(loose, lambda x: score(x) >= 0), apart)


def searched(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str, str]:
    """The columns keep of docs, base spans and all spans (base and added, by kind and start); the names of the last two."""
    base, loose, spans = (fresh(docs, f"{stem}_spans") for stem in ("base", "loose", "all"))
    rows = written(candidates(docs, keep, (base, loose)), "spans")
    added = _accepted(_model(rows, base, loose), loose)
    order = F.array_sort(
        F.transform(F.concat(base, added), lambda x: F.struct(F.array_position(F.array(*map(F.lit, ALL_KINDS)), x["kind"]).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    )
    return rows.withColumn(spans, order).drop(loose), base, spans


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and n_spans for each row of docs (doc_id, text)."""
    rows, base, spans = searched(docs, ["doc_id"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    n_added = (F.size(spans) - F.size(base)).cast("bigint").alias("n_added")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col(base)), 256).alias("base_sha256"), _joined(F.col(spans)).alias("spans"), n_added, F.size(spans).cast("bigint").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets, and n_chars where there is one."""
    rows, _, spans = searched(docs, docs.columns)
    text = F.coalesce(F.col("text"), F.lit(""))
    by_place = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    inner, outer = "struct<at:int,out:array<string>>", "struct<at:int,out:array<string>>"

    def replaced(part: Column, first: Column, items: Column) -> Column:
        """at and the text of part, which begins at first, up to the end of the last of items."""

        def step(acc: Column, x: Column) -> Column:
            gap = F.substring(part, acc["at"] - first + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
            mark = F.when(x["start"] >= acc["at"], F.concat(gap, F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.array(mark)).alias("out")).cast(inner)

        return F.aggregate(items, F.struct(first.alias("at"), F.array().alias("out")).cast(inner), step)

    def chunk(acc: Column, items: Column) -> Column:
        last = F.array_max(F.transform(items, lambda x: x["end"]))
        part = F.substring(text, acc["at"] + 1, F.greatest(last - acc["at"], F.lit(0)))
        own = let(part, lambda p: replaced(p, acc["at"], items))
        return let(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(x["out"], ""))).alias("out")).cast(outer))

    empty = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(outer)
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text)))
    clean = F.when(F.size(spans) == 0, F.col("text")).otherwise(F.aggregate(let(by_place, _chunks), empty, chunk, rest))
    out = rows.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("bigint")))
    return out.select(*docs.columns)
