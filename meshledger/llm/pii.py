"""Personal data by weak supervision, DataFrame functions only.

Patterns propose spans: the base forms (email, ip, card, phone), which always stay once they pass their check, and looser
forms (written-out emails, long ip addresses, cards with other separators, national phones, bank accounts, names after a title).
Five labelers vote for, against or not at all on every proposed span: its format (regex), a check sum or the like, a
gazetteer, keywords before it, and the characters around it. Expectation-maximisation over the counts of each combination of votes
estimates how far each labeler can be relied on for each kind, without any label (a two-class model of independent labelers). A
logistic classifier of votes and shape starts at the estimated log odds and is trained on the expected labels, corrected by what is
certain: a span whose check fails is none. So shapes that such spans have count against the others; it decides on the spans that are no base ones. A span whose check fails, and one that overlaps a base span, is never added.

The text is read once: its spans and votes are staged, the model is a few hundred numbers learned from counts of vote
combinations (``3 ** 5 * 2 ** 3`` at most for a kind), and the staged spans are scored. No row is shuffled but these counts.

Positions are sums of the lengths between matches, taken in blocks of ``BLOCK``, so texts with very many matches stay cheap.

Defined results: null and empty texts have no spans and the digest of the empty string; repeated rows get a row each; rows
without id keep their null id; an empty table gives an empty result. Positions are code points. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm.shared import stage, table

#: Probability a looser span needs; context read before a span, in code points; matches summed up at once.
THRESHOLD, CONTEXT, BLOCK = 0.9, 24, 256
#: Rounds of expectation-maximisation and of the classifier's training; weight of the assumed reliabilities, in spans.
EM_ROUNDS, TRAIN_ROUNDS, ASSUMED = 20, 40, 4.0
#: Kinds in the order of a digest.
KINDS = ("email", "ip", "card", "phone", "iban", "name")
LABELERS = ("format", "check", "gazetteer", "before", "around")
SHAPES = ("spaced", "long", "opening")
#: Assumed chances of a vote against, none, and for, of a false and of a true span.
FALSE_SPAN, TRUE_SPAN = (0.45, 0.35, 0.2), (0.05, 0.25, 0.7)

#: Gazetteers.
DOMAINS = "com|org|net|edu|gov|int|info|biz|eu|de|at|ch|fr|es|it|pt|nl|be|uk|ie|us|ca|mx|ar|br|au|in|jp|cn|ru|pl|se|no|fi|dk|io"
FILES = "png|jpe?g|gif|svg|webp|css|js|html?|py|java|md|txt|pdf|zip|gz"
CALLING = "1|7|2[07]|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6011|64[4-9]|65|35(?:2[89]|[3-8])|30[0-5]|3[689]"
RESERVED = "0+\\.|10\\.|127\\.|169\\.254\\.|192\\.168\\.|172\\.(?:1[6-9]|2[0-9]|3[01])\\.|22[4-9]\\.|2[3-5][0-9]\\."
BANKS = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR"
GIVEN = ("Anna|Anne|Carlos|Carmen|Claire|David|Elena|Emma|Eva|Felix|Hans|Isabel|Jack|James|Jan|Jane|Javier|Jean|John|José|Juan|"
         "Julia|Karl|Klaus|Laura|Luca|Luis|Lukas|Maria|Marie|Mark|Martin|Mary|Michael|Miguel|Nicolas|Paul|Pedro|Peter|Pierre|"
         "Robert|Sarah|Sofia|Sophie|Stefan|Susan|Thomas|William")
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Señor|Señora|Mme|Monsieur|Madame"
#: Words before a span that speak for its kind, and words that speak against any of them.
WORDS = {
    "email": "mail|contact|kontakt|correo|courriel|write to|reach",
    "ip": "\\bip\\b|address|adresse|dirección|host|server|client",
    "card": "card|visa|mastercard|amex|karte|tarjeta|carte|credit",
    "phone": "tel|phone|call|mobile|mobil|fax|cell|appel|llam",
    "iban": "iban|account|konto|cuenta|compte|bank",
    "name": "\\bby\\b|from|dear|name|patient|contact|signed|\\bvon\\b|\\bpar\\b|\\bpor\\b",
}
AGAINST = "order|invoice|isbn|issn|serial|tracking|version|release|section|ticket|article|hash|token|\\bref|\\bid\\b"

_LOCAL = "[A-Za-z0-9._%+-]"
_AT, _DOT = " ?[\\[(] ?(?:at|AT) ?[\\])] ?", " ?[\\[(] ?(?:dot|DOT) ?[\\])] ?"
_CAPITAL = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++"


@dataclass(frozen=True)
class Form:
    """A pattern of a kind. Texts without a match of ``needs`` are not searched; base forms have a check of their own."""

    kind: str
    pattern: str
    needs: str
    base: Callable[[Column], Column] | None = None


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _between(count: Column, least: int, most: int) -> Column:
    return (count >= least) & (count <= most)


def _is_card(text: Column) -> Column:
    return _between(F.length(_digits(text)), 13, 19) & F.call_function("luhn_check", _digits(text))


#: A part of an ip address: at most 255, with any number of leading zeros.
_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
#: The base forms, and the looser ones. Possessive repeats and starts at the edge of a run (or of the match before) find
#: what the plain patterns find, in one pass.
FORMS = (
    Form("email", f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@", lambda hit: F.lit(True)),
    Form("ip", "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "[0-9]\\.[0-9]", lambda hit: hit.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$")),
    Form("card", "[0-9](?:[ -]?[0-9])++", "[0-9]", _is_card),
    Form("phone", "\\+[0-9][ ().0-9-]+[0-9]", "\\+[0-9]", lambda hit: _between(F.length(_digits(hit)), 9, 15)),
    Form("email", f"(?<!{_LOCAL}){_LOCAL}++{_AT}[A-Za-z0-9-]++(?:(?:{_DOT}|\\.)[A-Za-z0-9-]++)++", _AT),
    Form("ip", "(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", "[0-9A-Fa-f]:[0-9A-Fa-f]"),
    Form("card", "(?<![0-9])[0-9]{4}(?:[./_ ]{1,3}[0-9]{4}){3}(?![0-9])", "[0-9]{4}[./_ ]"),
    Form("phone", "(?<![0-9+])(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", "[0-9]{3}[ .-][0-9]{4}"),
    Form("iban", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    Form("name", f"(?<![A-Za-zÀ-ÿ])(?:{TITLES})\\.? {_CAPITAL}(?: {_CAPITAL})?+", f"(?:{TITLES})\\.? [A-ZÀ-Þ]"),
)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda total, one: total + one)


def _upto(last: Column) -> Column:
    return F.sequence(F.lit(0), last)


def matches(text: Column, pattern: str) -> Column:
    """(start, end, hit, before, after) of all matches, null if there are none. Texts between matches and their lengths give the
    positions: whole blocks first, then what is left of a match's own block."""
    def place(x: Column) -> Column:
        parts, hits = x["parts"], x["hits"]
        lengths = F.transform(hits, lambda hit, i: F.char_length(F.get(parts, i)) + F.char_length(hit))
        block = lambda i: F.floor(i / BLOCK).cast("int")

        def with_lengths(length: Column) -> Column:
            last = block(F.size(hits) - 1)
            sums = F.transform(_upto(last), lambda b: _sum(F.slice(length, b * BLOCK + 1, F.lit(BLOCK))))
            before = bind(sums, lambda total: F.transform(_upto(last), lambda b: _sum(F.slice(total, F.lit(1), b))))

            def with_blocks(full: Column) -> Column:
                def one(hit: Column, i: Column) -> Column:
                    start = (F.get(full, block(i)) + _sum(F.slice(length, block(i) * BLOCK + 1, i % BLOCK))
                             + F.char_length(F.get(parts, i)))
                    return bind(start, lambda start: F.struct(
                        start.alias("start"), (start + F.char_length(hit)).alias("end"), hit.alias("hit"),
                        F.right(F.get(parts, i), F.lit(CONTEXT)).alias("before"),
                        F.left(F.get(parts, i + 1), F.lit(2)).alias("after")))
                return F.transform(hits, one)
            return bind(before, with_blocks)
        return bind(lengths, with_lengths)

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(
        F.size(hits) > 0, bind(F.struct(F.split(text, pattern, -1).alias("parts"), hits.alias("hits")), place)))


def _vote(for_: Column, against: Column) -> Column:
    return F.when(against, 0).when(for_, 2).otherwise(1)


def _account_rest(text: Column) -> Column:
    """An account number modulo 97, its first four signs moved to the end and letters read as numbers from 10."""
    plain = F.regexp_replace(text, " ", "")
    signs = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")
    value = lambda sign: F.when(sign.rlike("[0-9]"), sign.cast("int")).otherwise(F.ascii(sign) - 55)
    return F.aggregate(signs, F.lit(0), lambda rest, sign: F.when(sign == "", rest).otherwise(
        (rest * F.when(sign.rlike("[0-9]"), 10).otherwise(100) + value(sign)) % 97))


def votes(kind: str, hit: Column, before: Column, after: Column) -> list[Column]:
    """A vote of each labeler: 0 against, 1 none, 2 for."""
    no, digits = F.lit(False), _digits(hit)
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(hit, _AT, "@"), _DOT, ".")
        form = _vote(plain.rlike("^[A-Za-z0-9_%+-]++(?:\\.[A-Za-z0-9_%+-]++)*+@(?:[A-Za-z0-9-]++\\.)++[A-Za-z]{2,24}$"), plain.rlike("\\.\\.|^\\.|\\.@|@-"))
        check = _vote(no, F.char_length(plain) > 254)
        known = _vote(plain.rlike(f"\\.(?:{DOMAINS})$"), plain.rlike(f"\\.(?:{FILES})$"))
        around = _vote(no, before.rlike("[/@]$") | after.rlike("^@"))
    elif kind == "ip":
        form = _vote(hit.rlike("^(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$|:"), hit.rlike("(?:^|\\.)0[0-9]"))
        check = _vote(no, ~hit.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$") & ~hit.contains(":"))
        known = _vote(no, hit.rlike(f"^(?:{RESERVED})|^(?:0{{1,4}}:){{7}}"))
        around = _vote(no, before.rlike("[0-9A-Za-z]\\.?$") | after.rlike("^\\.?[0-9A-Za-z]"))
    elif kind == "card":
        form = _vote(hit.rlike("^(?:[0-9]{4}([ -]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}|[0-9]{4}([ -]?)[0-9]{6}\\2[0-9]{5})$"),
                     ~_between(F.length(digits), 13, 19))
        check = _vote(_is_card(hit), ~_is_card(hit))
        known = _vote(digits.rlike(f"^(?:{ISSUERS})"), digits.rlike("^[01789]"))
        around = _vote(no, before.rlike("[0-9A-Za-z._=-]$") | after.rlike("^[0-9A-Za-z_=-]"))
    elif kind == "phone":
        form = _vote(hit.rlike("^\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,4}\\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}$|^\\("), hit.rlike("[.-]{2}|\\.[0-9]{1}\\."))
        check = _vote(no, ~_between(F.length(digits), 9, 15) | digits.rlike("^([0-9])\\1+$"))
        known = F.when(hit.startswith("+"), _vote(digits.rlike(f"^(?:{CALLING})"), digits.rlike("^0"))).otherwise(
            _vote(digits.rlike("^[2-9][0-9]{2}[2-9]"), digits.rlike("^[01]")))
        around = _vote(no, before.rlike("[0-9A-Za-z=./-]$") | after.rlike("^[0-9A-Za-z=/-]"))
    elif kind == "iban":
        form = F.when(_between(F.length(F.regexp_replace(hit, " ", "")), 15, 34), 2).otherwise(0)
        check = F.when(_account_rest(hit) == 1, 2).otherwise(0)
        known = _vote(hit.rlike(f"^(?:{BANKS})"), ~hit.rlike(f"^(?:{BANKS})"))
        around = _vote(no, before.rlike("[=_/-]$") | after.rlike("^[=_/-]"))
    else:
        form = _vote(hit.rlike(f" {_CAPITAL} {_CAPITAL}$"), no)
        check = _vote(no, F.char_length(hit) > 60)
        known = _vote(hit.rlike(f"(?: |^)(?:{GIVEN})(?: |$)"), no)
        around = _vote(after.rlike("^[,;:.)\\n]"), after.rlike("^[-@_]"))
    context = _vote(before.rlike(f"(?i)(?:{WORDS[kind]})[^\\n]{{0,12}}$"), before.rlike(f"(?i)(?:{AGAINST})[^\\n]{{0,8}}$"))
    return [form, check, known, context, around]


def proposed(form: Form, text: Column) -> Column:
    """(kind, start, end, base, vote, shape) of a form's matches; a base form keeps its own check's verdict."""
    def one(span: Column) -> Column:
        hit, before, after = span["hit"], span["before"], span["after"]
        shape = [hit.rlike("[ ().-]"), F.char_length(hit) >= 16, (before == "") | before.endswith("\n")]
        return F.struct(F.lit(KINDS.index(form.kind)).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
                        (form.base(hit) if form.base else F.lit(False)).alias("base"),
                        F.array(*votes(form.kind, hit, before, after)).alias("vote"),
                        F.array(*[x.cast("int") for x in shape]).alias("shape"))
    return F.when(text.rlike(form.needs), F.transform(matches(text, form.pattern), one))


def spans(docs: DataFrame) -> DataFrame:
    """A row for each row: doc_id, base spans, and looser spans that overlap no base span, with their votes."""
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,vote:array<int>,shape:array<int>>>")
    text = F.coalesce(F.col("text"), F.lit(""))
    # A text without any sign that a form needs is searched once.
    worth = text.rlike(f"[@0-9]|{_AT}|(?:{TITLES})\\.? [A-ZÀ-Þ]")
    found = docs.select("doc_id", *[F.coalesce(F.when(worth, proposed(form, text)), empty).alias(f"f{i}") for i, form in enumerate(FORMS)])
    every = found.select("doc_id", F.concat(*[f"f{i}" for i in range(len(FORMS))]).alias("every"))
    split = every.select("doc_id", F.filter("every", lambda s: s["base"]).alias("base"), F.filter("every", lambda s: ~s["base"]).alias("loose"))
    apart = F.filter("loose", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return split.select("doc_id", "base", apart.alias("loose"))


def vote_counts(found: DataFrame) -> DataFrame:
    """(kind, rows): how often each combination of votes and shape occurs, for each kind in a fixed order."""
    each = found.select(F.explode(F.concat("base", "loose")).alias("s"))
    counts = each.groupBy("s.kind", "s.vote", "s.shape").agg(F.count("*").cast("double").alias("n"))
    return counts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("vote", "shape", "n"))).alias("rows"))


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def reliabilities(rows: Column) -> Column:
    """Expectation-maximisation: the share of true spans, then for each labeler and vote its chance for a false and a true
    span. The assumed chances count as ``ASSUMED`` spans, so a kind with few spans stays near them."""
    places = len(LABELERS)
    assumed = [p for _ in range(places) for pair in zip(FALSE_SPAN, TRUE_SPAN) for p in pair]
    chance = lambda theta, k, v, c: F.get(theta, 1 + (k * 3 + v) * 2 + c)

    def expect(theta: Column, row: Column) -> Column:
        odds = [reduce(lambda a, b: a * b, [chance(theta, k, F.get(row["vote"], F.lit(k)), c) for k in range(places)],
                       F.get(theta, F.lit(0)) if c else 1 - F.get(theta, F.lit(0))) for c in (0, 1)]
        return F.struct(row["vote"].alias("vote"), row["n"].alias("n"),
                        bind(F.struct(odds[0].alias("no"), odds[1].alias("yes")), lambda o: row["n"] * o["yes"] / (o["no"] + o["yes"])).alias("true"))

    def share(part: Column, weight: Callable[[Column], Column]) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda total, row: total + weight(row))

    def step(theta: Column, _: Column) -> Column:
        def maximise(part: Column) -> Column:
            weights = (lambda row: row["n"] - row["true"], lambda row: row["true"])
            totals = F.struct(share(part, weights[0]).alias("c0"), share(part, weights[1]).alias("c1"))

            def update(total: Column) -> Column:
                values = [(total["c1"] + ASSUMED / 2) / (total["c0"] + total["c1"] + ASSUMED)]
                for k in range(places):
                    for v in range(3):
                        for c in (0, 1):
                            seen = share(part, lambda row, k=k, v=v, c=c: F.when(
                                F.get(row["vote"], F.lit(k)) == v, weights[c](row)).otherwise(0.0))
                            values.append((seen + ASSUMED * (TRUE_SPAN if c else FALSE_SPAN)[v]) / (total[f"c{c}"] + ASSUMED))
                return F.array(*values)
            return bind(totals, update)
        return bind(F.transform(rows, lambda row: expect(theta, row)), maximise)

    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), _numbers([0.5, *assumed]), step)


def features(vote: Column, shape: Column) -> Column:
    """Inputs of the classifier: one, a place for each vote of each labeler, the shape."""
    return F.concat(_numbers([1.0]), F.flatten(F.transform(vote, lambda v: F.array(
        (v == 0).cast("double"), (v == 2).cast("double")))), F.transform(shape, lambda s: s.cast("double")))


def _dot(one: Column, two: Column) -> Column:
    return F.aggregate(F.zip_with(one, two, lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)


def _logistic(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))


def _log_odds(theta: Column) -> Column:
    """Weights that state the estimated reliabilities: votes of none count into the constant."""
    odds = lambda k, v: F.log(F.get(theta, F.lit(1 + (k * 3 + v) * 2 + 1)) / F.get(theta, F.lit(1 + (k * 3 + v) * 2)))
    prior = F.log(F.get(theta, F.lit(0)) / (1 - F.get(theta, F.lit(0))))
    places = range(len(LABELERS))
    constant = reduce(lambda a, b: a + b, [odds(k, 1) for k in places], prior)
    return F.array(constant, *[odds(k, v) - odds(k, 1) for k in places for v in (0, 2)], *[F.lit(0.0)] * len(SHAPES))


def trained(rows: Column, theta: Column) -> Column:
    """Weights of the logistic classifier: gradient steps on the expected labels, from the estimated log odds on.

    The estimate alone would be its own best fit, and no step would change it; the labels that a failed check settles are what
    it learns from."""
    start = _log_odds(theta)
    width = 1 + 2 * len(LABELERS) + len(SHAPES)
    labelled = bind(start, lambda w: F.transform(rows, lambda row: bind(features(row["vote"], row["shape"]), lambda x: F.struct(
        x.alias("x"), row["n"].alias("n"),
        F.when(F.get(row["vote"], F.lit(1)) == 0, 0.0).otherwise(_logistic(_dot(w, x))).alias("label")))))

    def step(data: Column) -> Callable[[Column, Column], Column]:
        def move(weights: Column, _: Column) -> Column:
            errors = F.transform(data, lambda row: F.struct(row["x"].alias("x"), row["n"].alias("n"), (
                row["n"] * (row["label"] - _logistic(_dot(weights, row["x"])))).alias("e")))

            def apply(part: Column) -> Column:
                total = F.aggregate(part, F.lit(ASSUMED), lambda t, row: t + row["n"])
                slope = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(
                    part, F.lit(0.0), lambda t, row: t + row["e"] * F.get(row["x"], j)))
                return bind(total, lambda t: F.zip_with(weights, slope, lambda w, s: w + s / t))
            return bind(errors, apply)
        return move

    return bind(F.struct(start.alias("w"), labelled.alias("data")), lambda m: F.aggregate(
        F.sequence(F.lit(1), F.lit(TRAIN_ROUNDS)), m["w"], step(m["data"])))


def learn(found: DataFrame) -> dict[int, tuple[list[float], list[float]]]:
    """Reliabilities and classifier weights of each kind that has spans: a few dozen numbers each."""
    model = vote_counts(found).select("kind", "rows", reliabilities(F.col("rows")).alias("theta"))
    model = model.select("kind", "theta", trained(F.col("rows"), F.col("theta")).alias("weights"))
    return {row.kind: (list(row.theta), list(row.weights)) for row in model.collect()}


def score(span: Column, model: dict[int, tuple[list[float], list[float]]]) -> Column:
    """Probability of a looser span; 0 if its check fails."""
    value = F.lit(0.0)
    for kind, (_, weights) in model.items():
        value = F.when(span["kind"] == kind, _logistic(_dot(_numbers(weights), features(span["vote"], span["shape"])))).otherwise(value)
    return F.when(F.get(span["vote"], F.lit(1)) == 0, 0.0).otherwise(value)


def _digest(part: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(F.sort_array(F.transform(part, lambda s: F.struct(s["kind"], s["start"], s["end"]))), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and added spans (kind, start, end) of every row."""
    found = stage(spans(docs))
    model = learn(found)
    plain = lambda part: F.transform(part, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    good = F.filter("loose", lambda s: score(s, model) >= threshold)
    # Two looser forms may propose overlapping spans: the one of the earlier kind, then of the earlier start, stays.
    clear = bind(good, lambda part: F.filter(part, lambda s: ~F.exists(part, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & (
        (o["kind"] < s["kind"]) | ((o["kind"] == s["kind"]) & (o["start"] < s["start"]))))))
    return found.select("doc_id", plain(F.col("base")).alias("base"), plain(clear).alias("added"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{KINDS[i]}") for i in range(4)]
    return found.select("doc_id", *counts, F.sha2(_digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _digest(F.concat("base", "added")).alias("spans"))
