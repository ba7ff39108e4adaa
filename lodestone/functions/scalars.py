"""Scalar expressions: numbers in text, names, labels, citations, maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels by priority; the smallest that a result has is its primary one.
LABEL_PRIORITY = {
    "table": 1, "code": 2, "form": 3, "field_region": 3, "key_value_region": 4, "field_item": 4, "field_key": 5, "field_value": 6, "field_heading": 7, "list_item": 8,
    "formula": 9, "chart": 10, "picture": 11, "caption": 12, "footnote": 13, "field_hint": 14, "marker": 15, "section_header": 16, "title": 17,
}
# Words that scale the number before them.
SCALE = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
# Patterns of numbers, of scaled numbers, of a submitted number, and of a declared answer.
NUMBER = r"[(-]?\$?\d[\d,]*(?:\.\d+)?%?\)?"
SCALED = r"(?i)[(-]?\$?\d[\d,]*(?:\.\d+)?\s*(?:thousand|million|billion|trillion)"
SUBMITTED = r"[-−]?\$?\s*\d[\d,]*(?:\.\d+)?\s*%?"
ANSWER = r"(?im)^[\s*>#_-]*(?:final\s+)?answer\s*[:=]\s*(.+)$"


def _value(token: Column) -> Column:
    plain = F.regexp_replace(token, r"[^0-9.]", "").cast("double")
    return F.when(token.rlike(r"^[(-]"), -plain).otherwise(plain)


def numbers(text: Column) -> Column:
    """All readings of the numbers of a text: those written, percentages also as fractions, scaled ones also in full."""
    t = F.replace(text, F.lit("−"), F.lit("-"))
    plain = F.transform(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), lambda x: F.when(F.contains(x, F.lit("%")), F.array(_value(x), _value(x) / 100)).otherwise(F.array(_value(x))))
    factor = F.create_map(*[F.lit(v) for pair in SCALE.items() for v in pair])
    scaled = F.transform(F.regexp_extract_all(t, F.lit(SCALED), F.lit(0)), lambda x: _value(F.regexp_extract(x, r"^(\S*\d)", 1)) * factor[F.lower(F.regexp_extract(x, "([A-Za-z]+)$", 1))])
    return F.filter(F.concat(F.flatten(plain), scaled), lambda x: x.isNotNull())


def answer_segment(text: Column) -> Column:
    """The last declared answer, else the whole text."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(ANSWER), F.lit(1)), F.lit(-1)), text)


def number_match(predicted: Column, gold: Column, eps: float = 0.01) -> Column:
    """1 if some number of the answer is the first of the gold one, sign aside, as it stands or 100 or 1000 times off; else 0."""
    target, found = F.abs(F.get(numbers(gold), F.lit(0))), numbers(answer_segment(predicted))
    scales = F.array(*[F.lit(s) for s in (1.0, 0.01, 100.0, 0.001, 1000.0)])
    close = lambda v: F.when(target == 0, v == 0).otherwise(F.abs(v - target) / target <= eps)
    return F.coalesce(F.exists(found, lambda c: F.exists(scales, lambda s: close(F.abs(c) * s))), F.lit(False)).cast("int")


def submission(text: Column) -> Column:
    """The first number of the answer as decimal text: a percentage as a fraction, whole numbers without a point; empty if none.

    Brackets are no sign here. Digits are kept as written; numbers of more than 24 digits before the point or 12 after it
    go through a double.
    """
    token = F.regexp_extract(answer_segment(text), f"({SUBMITTED})", 1)
    plain = F.replace(F.regexp_replace(token, r"[$,%\s]", ""), F.lit("−"), F.lit("-"))
    percent = F.when(F.contains(token, F.lit("%")), F.lit("0.01")).otherwise(F.lit("1")).cast("decimal(3,2)")
    short = F.length(F.regexp_replace(plain, r"^-|\..*$", "")) <= 24
    exact = F.when(short & (F.length(F.regexp_extract(plain, r"\.(\d+)$", 1)) <= 12), (plain.try_cast("decimal(36,12)").cast("decimal(34,12)") * percent).cast("string"))
    shown = F.when(F.contains(exact, F.lit(".")), F.regexp_replace(exact, r"\.?0+$", "")).otherwise(exact)
    rough = plain.try_cast("double") * percent.cast("double")
    return F.coalesce(F.when(token != "", F.coalesce(F.when(shown == "-0", F.lit("0")).otherwise(shown), rough.cast("string"))), F.lit(""))


def primary_label(labels: Column) -> Column:
    """The label of highest priority, of equals the first; without any, the first label."""
    rank = F.create_map(*[F.lit(v) for pair in LABEL_PRIORITY.items() for v in pair])
    known = F.filter(F.transform(labels, lambda x, i: F.struct(rank[x].alias("p"), i.alias("i"), x.alias("l"))), lambda s: s["p"].isNotNull())
    return F.coalesce(F.array_min(known)["l"], F.get(labels, F.lit(0)))


def name_filter(names: list[str], uri: Column, title: Column) -> Column | None:
    """Documents whose uri or title contains a name, case aside, also without blanks; None for no names.

    ``%`` and ``_`` of a name match as wildcards.
    """
    bare = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))

    def one(name: str) -> Column:
        low = name.lower()
        like = lambda c, n: c.like(f"%{n}%")
        return reduce(lambda a, b: a | b, [like(F.lower(c), low) for c in (uri, title)] + [like(bare(c), low.replace(" ", "")) for c in (uri, title)])

    return reduce(lambda a, b: a | b, map(one, names)) if names else None


def merge_maps(*maps: Column) -> Column:
    """Maps merged so that later values win; null maps are empty."""
    return reduce(lambda a, b: F.when(b.isNull(), a).when(a.isNull(), b).otherwise(F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)), maps)


def rename_keys(m: Column, names: dict[str, str]) -> Column:
    """A map with renamed keys; a value that has the new key already stays."""
    old = list(names)
    moved = F.map_filter(m, lambda k, _: k.isin(*old))
    to = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return merge_maps(F.transform_keys(moved, lambda k, _: to[k]), F.map_filter(m, lambda k, _: ~k.isin(*old)))


def contextualised(headings: Column, content: Column) -> Column:
    """Headings, a line each, before the content; the content alone without any."""
    return F.when(F.coalesce(F.size(headings), F.lit(0)) > 0, F.concat_ws("\n", F.array_join(headings, "\n"), content)).otherwise(content)


def page_label(pages: Column) -> Column:
    """``p. 3`` or ``pp. 3-5``; null without pages."""
    lo, hi = F.array_min(pages), F.array_max(pages)
    return F.when(F.coalesce(F.size(pages), F.lit(0)) < 1, None).when(lo == hi, F.concat(F.lit("p. "), lo)).otherwise(F.concat(F.lit("pp. "), lo, F.lit("-"), hi))


def byte_label(n: Column) -> Column:
    """A size in the largest fitting unit, with one decimal."""
    out = F.when(n < 1024, F.format_string("%.1f B", n.cast("double")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = out.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", n / 1024**power))
    return out.otherwise(F.format_string("%.1f PB", n / 1024**5))


def version_key(text: Column) -> Column:
    """The numbers of a version as an array, which compares as versions do."""
    return F.transform(F.split(F.regexp_replace(text, "^v", ""), r"\."), lambda x: F.regexp_extract(x, r"^(\d+)", 1).try_cast("int"))


def agent_text(chunk_id: Column, score: Column, rank: Column, total: Column, title: Column, headings: Column, labels: Column, captions: Column, content: Column) -> Column:
    """A search result as text for a model: place or score, source, kind, captions, content. Null parts are left out."""
    place = F.when(rank.isNull(), F.format_string("(score: %.2f)", score.cast("double"))).when(total.isNull(), F.concat(F.lit("[rank "), rank.cast("string"), F.lit("]")))
    place = place.otherwise(F.concat(F.lit("[rank "), rank.cast("string"), F.lit(" of "), total.cast("string"), F.lit("]")))
    named = F.when(title != "", F.concat(F.lit('"'), title, F.lit('"')))
    path = F.when(F.size(headings) > 0, F.array_join(headings, " > "))
    source = F.when(named.isNotNull() | path.isNotNull(), F.concat(F.lit("Source: "), F.concat_ws(" > ", named, path)))
    kind = F.concat(F.lit("Type: "), primary_label(labels))
    told = F.filter(F.map_entries(captions), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    figures = F.transform(told, lambda e: F.concat(F.lit("Figure caption ("), e["key"], F.lit("): "), e["value"]))
    return F.concat_ws("\n", F.concat(F.lit("["), chunk_id, F.lit("] "), place), source, kind, figures, F.concat(F.lit("Content:\n"), F.coalesce(content, F.lit(""))))


def citation_text(number: Column, title: Column, uri: Column, pages: Column, headings: Column, pictures: Column, content: Column) -> Column:
    """A citation as plain text: number, title or else uri, place, figures and content, a line each, and an empty line."""
    n = F.coalesce(F.size(pages), F.lit(0))
    first, last = F.get(pages, F.lit(0)).cast("string"), F.get(pages, n - 1).cast("string")
    where = F.when(n == 1, F.concat(F.lit("p. "), first)).when(n > 1, F.concat(F.lit("pp. "), first, F.lit("-"), last))
    section = F.get(headings, F.coalesce(F.size(headings), F.lit(0)) - 1)
    place = F.concat_ws(", ", where, F.when(section != "", F.concat(F.lit("Section: "), section)))
    source = F.concat_ws(" - ", F.coalesce(uri, F.lit("")), F.when(place != "", place))
    named = F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(F.when(title != "", title), uri, F.lit("")), F.lit(" "), source)
    figures = F.transform(F.coalesce(pictures, F.array().cast("array<string>")), lambda r: F.concat(F.lit("[Figure: "), r, F.lit("]")))
    return F.concat_ws("\n", named, figures, F.coalesce(content, F.lit("")), F.lit(""))


def cited_texts(texts: Column) -> Column:
    """All citations of an answer under their heading; empty without any."""
    return F.when(F.size(texts) > 0, F.concat_ws("\n", F.lit("## Citations\n"), texts)).otherwise("")


def meta_options(options: Column) -> Column:
    """A map of ``KEY=VALUE`` texts, the value as JSON text: a literal where it is valid JSON, else a string; later keys win.

    An option without ``=`` or without a key is an error, a null option is left out.
    """
    key, value = lambda o: F.substring_index(o, "=", 1), lambda o: F.substring(o, F.instr(o, "=") + 1, F.length(o))
    bad = lambda o: ~F.contains(o, F.lit("=")) | F.startswith(o, F.lit("="))
    quoted = lambda v: F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    told = F.filter(options, lambda o: o.isNotNull())
    last = F.filter(told, lambda o, i: ~F.exists(F.slice(told, i + 2, F.size(told)), lambda p: key(p) == key(o)))
    one = lambda o: F.struct(F.when(bad(o), F.raise_error(F.lit("an option must be KEY=VALUE")).cast("string")).otherwise(key(o)).alias("key"), F.coalesce(F.to_json(F.try_parse_json(value(o))), quoted(value(o))).alias("value"))
    return F.map_from_entries(F.transform(last, one))


def decoded_uri(uri: Column) -> Column:
    """The bytes of a base64 data URI; null for others and for what is not base64."""
    return F.try_to_binary(F.when(uri.rlike(r"^data:[^,]*;base64,"), F.regexp_replace(uri, r"^data:[^,]*,", "")), F.lit("base64"))


def data_uri(data: Column, kind: str = "image/png") -> Column:
    """Bytes as a base64 data URI, without the line breaks that some settings put in."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(data), r"\s", ""))
