"""Title cleaning and HTML entities, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "squot": "'", "nbsp": "\u00a0",
}
IDEAL_LENGTH = 150
AWKWARD_LENGTH = 200
MAX_COMMA_CHOP = 50
SIMPLER_PHRASES = (
    ("A study of ", "Study of "),
    ("A review", "Review"),
    (" found that ", " found "),
    (" showed that ", " showed "),
)
# --- end of fixed values ------------------------------------------------------------

_ENTITY = "&[^;]*;"


def _char(code: Column) -> Column:
    """Character of a code point; null outside Unicode or for a surrogate."""
    ok = (code >= 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    packed = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return F.when(ok, F.decode(packed, "UTF-32"))


def _decode_entity(entity: Column) -> Column:
    name = F.substring(entity, 2, F.length(entity) - 2)
    hex_digits = F.regexp_extract(name, r"^#x\+?0*([0-9a-fA-F]{1,8})$", 1)
    dec_digits = F.regexp_extract(name, r"^#\+?0*([0-9]{1,10})$", 1)
    out = F.when(hex_digits != "", _char(F.conv(hex_digits, 16, 10).cast("bigint")))
    out = out.when(dec_digits != "", _char(dec_digits.cast("bigint")))
    for key, value in NAMED_ENTITIES.items():
        out = out.when(name == key, F.lit(value))
    return F.coalesce(out, entity)


def unescape_entities(text: Column) -> Column:
    """Decode named, decimal and hex entities; anything else passes through.

    An ampersand opens an entity that runs to the next semicolon, so a stray "&" before a
    good entity hides it. A lone "&" at the very end is dropped.
    """
    parts = F.struct(
        F.split(text, _ENTITY, -1).alias("plain"),
        F.regexp_extract_all(text, F.lit(f"({_ENTITY})"), 1).alias("coded"))

    def join(p: Column) -> Column:
        last = F.element_at(p["plain"], -1)
        closed = F.when(last.rlike("^[^&]*&$"), F.rtrim(last, F.lit("&"))).otherwise(last)
        body = F.zip_with(F.slice(p["plain"], 1, F.size(p["coded"])), p["coded"],
                          lambda a, e: F.concat(a, _decode_entity(e)))
        return F.concat(F.array_join(body, ""), closed)

    # transform over a one-element array takes the text apart once
    joined = F.get(F.transform(F.array(parts), join), F.lit(0))
    return F.when(~text.contains("&"), text).otherwise(joined)


def remove_edge_tags(title: Column) -> Column:
    """Drop one leading and one trailing ``[word]`` of 1 to 9 letters, never the rest."""
    t = F.trim(title)
    head = F.regexp_replace(t, r"^\[[A-Za-z]{1,9}\]", "")
    tail = F.regexp_replace(head, r"\[[A-Za-z]{1,9}\]$", "")
    return (F.when(~t.contains("["), t).when(F.trim(head) == "", t).when(F.trim(tail) == "", t)
            .otherwise(F.trim(tail)))


def _before_last(text: Column, sep: str) -> tuple[Column, Column]:
    """Parts before and after the last separator; the first is null without one."""
    right = F.substring_index(text, sep, -1)
    left = F.substring(text, F.lit(1), F.length(text) - F.length(right) - len(sep))
    return F.when(text.contains(sep), left), right


def _cut_while(text: Column, sep: str, limit: int) -> Column:
    """Cut at the last separator again and again until the text fits in ``limit`` bytes."""
    cuts = F.sequence(F.lit(1), F.greatest(F.size(F.split(text, _quoted(sep), -1)), F.lit(1)))

    def step(acc: Column, _i: Column) -> Column:
        left, _right = _before_last(acc, sep)
        return F.when(F.octet_length(acc) <= limit, acc).otherwise(F.coalesce(left, acc))

    return F.aggregate(cuts, text, step)


def _quoted(sep: str) -> str:
    return sep.replace(".", r"\.").replace("|", r"\|")


def _chop_commas(text: Column) -> Column:
    cuts = F.sequence(F.lit(1), F.size(F.split(text, ", ", -1)))

    def step(acc: Column, _i: Column) -> Column:
        left, right = _before_last(acc, ", ")
        stop = (left.isNull() | (F.octet_length(acc) <= AWKWARD_LENGTH)
                | (F.octet_length(right) > MAX_COMMA_CHOP))
        return F.when(stop, acc).otherwise(F.concat(left, F.lit("…")))

    return F.aggregate(cuts, text, step)


def trim_title(title: Column, ideal: int = IDEAL_LENGTH,
               awkward: int = AWKWARD_LENGTH) -> Column:
    """Shorten a long title: bars, then sentences, then phrases, then commas."""
    cut = _cut_while(_cut_while(title, " | ", ideal), ". ", ideal)
    plain = cut
    for long, short in SIMPLER_PHRASES:
        plain = F.replace(plain, F.lit(long), F.lit(short))
    return (F.when(F.octet_length(title) <= ideal, title)
            .when(F.octet_length(cut) <= awkward, cut)
            .otherwise(_chop_commas(plain)))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(title), F.lit(" "), F.lit("-")),
                            r"[^\p{L}\p{N}_-]", "")


def text_tokens(text: Column) -> Column:
    """Search tokens: lower case, split at anything that is no letter or digit."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: t != "")


def looks_like_bot(agent: Column) -> Column:
    """User agents that name a bot, a link or a scripting client."""
    return F.lower(agent).rlike("bot|http:|https:|python|curl")
