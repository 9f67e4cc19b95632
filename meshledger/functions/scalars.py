"""Scalar functions: Column in, Column out, all inside codegen."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshledger.registry import SEPARATOR

# Texts the slug rule spells out before anything else.
SLUG_WORDS = {"&": "and", "@": "at"}
SLUG_DROPPED = "\"'’"
SLUG_DASHES = "‒–—―"
# Letters with no one-letter base form.
SLUG_LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
# Cyrillic and Greek letters in Latin ones; the soft and the hard sign are marks, so dashes.
SLUG_LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "-", "ы": "y", "ь": "-", "э": "e", "ю": "iu", "я": "ia", "ђ": "dj", "ѓ": "gj",
    "є": "ie", "ѕ": "dz", "і": "i", "ї": "yi", "ј": "j", "љ": "lj", "њ": "nj", "ќ": "kj", "џ": "dz",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps",
    "ω": "o", "ά": "a", "έ": "e", "ή": "e", "ί": "i", "ό": "o", "ύ": "u", "ώ": "o", "ϊ": "i", "ϋ": "u",
}


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters they are built on, by Unicode's rule."""
    marked, plain = "øđłı", "odli"
    for code in range(0xC0, 0x250):
        letter = chr(code)
        base = unicodedata.normalize("NFKD", letter)[0]
        if letter != base and base.isascii() and letter == letter.lower():
            marked, plain = marked + letter, plain + base.lower()
    return marked, plain


_MARKED, _PLAIN = _accent_table()


def slugify(text: Column) -> Column:
    """URL-safe short form: ``192.168.0.1/22`` becomes ``192-168-0-1-22``."""
    out = F.lower(text)
    for word, spelled in SLUG_WORDS.items():
        out = F.replace(out, F.lit(word), F.lit(spelled))
    for ligature, spelled in SLUG_LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(spelled))
    letters = F.create_map(*[F.lit(x) for pair in SLUG_LETTERS.items() for x in pair])
    latin = F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(F.try_element_at(letters, c), c)), "")
    out = F.when(out.rlike("[\u0370-\u03ff\u0400-\u045f]"), latin).otherwise(out)
    out = F.translate(out, _MARKED + SLUG_DASHES + SLUG_DROPPED, _PLAIN + "-" * len(SLUG_DASHES))
    out = F.regexp_replace(F.trim(out), "[^a-z0-9_-]", "-")
    out = F.regexp_replace(out, "-+", "-")
    return F.btrim(out, F.lit("-_"))


def absent_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def fill_slug(slug: Column, name: Column) -> Column:
    return F.coalesce(absent_if_empty(slug), slugify(name))


def unwrap_choice(text: Column) -> Column:
    """``{"value": x, "label": y}`` gives ``x``; any other text stays as it is."""
    return F.when(F.ltrim(text).startswith("{"),
                  F.coalesce(F.get_json_object(text, "$.value"), text)).otherwise(text)


def natural_key(*parts: Column) -> Column:
    """Key of an object: its name and the names that scope it, absent parts as empty text."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(p, F.lit("")) for p in parts])


def key_part(key: Column, position: int) -> Column:
    return absent_if_empty(F.split_part(key, F.lit(SEPARATOR), F.lit(position)))


def scoped_identity(*names: Column) -> Column:
    """Identity of interfaces and addresses: slug of the name and its scope."""
    return slugify(F.concat_ws("-", *[F.coalesce(n, F.lit("")) for n in names]))


def identity_of_key(key: Column) -> Column:
    return slugify(F.replace(key, F.lit(SEPARATOR), F.lit("-")))


def content_key(*parts: Column) -> Column:
    """Printable content hash; parts are joined by a character no name holds."""
    return F.md5(F.concat_ws(SEPARATOR, *parts))


def assigned_id(object_type: Column, object_key: Column) -> Column:
    """Id of an object created by a job: 60 bits of its key's hash, the same on every run."""
    return F.conv(F.substring(content_key(object_type, object_key), 1, 15), 16, 10).cast("bigint")


#: Between the parts of an arrival order; it sorts before every printable character an id may hold.
ORDER_MARK = "\x01"


def _copy_mark(copy: Column, mark: str) -> Column:
    """Nothing for the first delivery of a request; later ones sort after all its positions."""
    return F.when(copy > 0, F.concat(F.lit("c"), F.lpad(copy.cast("string"), 10, "0"), F.lit(mark))).otherwise("")


def arrival_order(ingestion_ts: Column, request_id: Column, position: Column, copy: Column | None = None) -> Column:
    """Text that sorts like (arrival time, request, delivery, position); also the id of a root entity."""
    return F.concat(F.lpad(ingestion_ts.cast("string"), 20, "0"), F.lit(ORDER_MARK), request_id, F.lit(ORDER_MARK),
                    _copy_mark(F.lit(0) if copy is None else copy, ORDER_MARK), F.lpad(position.cast("string"), 10, "0"))


def log_id(ingestion_ts: Column, request_id: Column, position: Column, copy: Column | None = None) -> Column:
    """Time-sortable id of a log record, unique per (time, request, delivery, position): no part is cut."""
    return F.concat(F.lpad(F.hex(ingestion_ts), 16, "0"), F.lit("-"), F.md5(request_id), F.lit("-"),
                    _copy_mark(F.lit(0) if copy is None else copy, "-"), F.lpad(position.cast("string"), 10, "0"))


def log_key(object_type: Column, ingestion_ts: Column, record_id: Column) -> Column:
    return F.format_string("ingest-entity:%s-%d-%s", object_type, ingestion_ts, record_id)


def page_token(offset: Column) -> Column:
    """Offset as a big-endian 32-bit number in base64."""
    return F.base64(F.unhex(F.right(F.lpad(F.hex(offset), 16, "0"), F.lit(8))))


def page_offset(token: Column) -> Column:
    """Offset in a token; a token that cannot be read means the first page."""
    raw = F.hex(F.try_to_binary(token, F.lit("base64")))
    value = F.conv(F.substring(raw, 1, 8), 16, 10).cast("bigint")
    signed = F.when(value >= 2**31, value - 2**32).otherwise(value)
    return F.when((F.length(raw) >= 8) & (token != ""), signed).otherwise(F.lit(0)).cast("int")


STATES = ("UNSPECIFIED", "QUEUED", "RECONCILED", "FAILED", "NO_CHANGES")


def state_name(number: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in enumerate(STATES) for x in pair]), number)


def state_number(name: Column) -> Column:
    pairs = [F.lit(x) for number, state in enumerate(STATES) for x in (state, number)]
    return F.element_at(F.create_map(*pairs), name)


def unquote_ingestion_ts(text: Column) -> Column:
    return F.regexp_replace(text, '"ingestionTs":"(\\d+)"', '"ingestionTs":$1')


def parse_timestamp(text: Column) -> Column:
    """(value, error) of an arrival time given as text."""
    value = text.try_cast("bigint")
    error = F.when(value.isNull(), F.concat(F.lit("failed to convert ingestion timestamp: "),
                                            F.coalesce(text, F.lit("null"))))
    return F.struct(value.alias("value"), error.alias("error"))


def apply_error_text(response: Column) -> Column:
    return F.format_string(
        "msg: %s, code: %d, change set id: %s, result: %s, errors: %s",
        response["message"], response["code"], response["change_set_id"], response["result"],
        F.coalesce(F.to_json(response["errors"]), F.lit("null")),
    )


def normalized_error(apply_error: Column, message: Column) -> Column:
    """An apply error keeps its code and details; any other message gets code 0."""
    plain = F.struct(message.alias("message"), F.lit(0).alias("code"),
                     F.lit(None).cast(apply_error_details_type()).alias("details"))
    return F.coalesce(apply_error, F.when(message.isNotNull(), plain))


def apply_error_details_type():
    from meshledger.schemas import ERROR

    return ERROR["details"].dataType
