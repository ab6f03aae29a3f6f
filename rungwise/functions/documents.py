"""JSON encoded in strings, request URLs and bodies, archive paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rungwise.functions.text import decimal_text
from rungwise.functions.times import utc_timestamp

BODY_SCHEMA = "end_ts bigint, fidelity bigint, markets array<string>, start_ts bigint"
MAX_TOKENS_PER_REQUEST = 20

# Query fields of an event page request.
PAGE_FIELDS = ("closed", "end_date_max", "end_date_min", "limit", "title_search")
CURSOR_FIELD = "after_cursor"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _true(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


# An array of strings without escapes, blanks between them or control characters.
PLAIN_LIST = r'^\["[^"\\\x00-\x1f]*"(?:,"[^"\\\x00-\x1f]*")*\]\z'


def json_list(text: Column | str) -> Column:
    """Array encoded as JSON text; null unless it is an array. Plain lists are cut, not parsed."""
    text = _col(text)
    cut = F.split(F.substring(text, F.lit(3), F.length(text) - 4), '","')
    return F.when(text.rlike(PLAIN_LIST), cut).when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))


def terminal_label(prices: Column) -> Column:
    """1.0 for numeric prices [1,0], 0.0 for [0,1], null for anything else."""
    yes, no = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    return F.when(prices == yes, 1.0).when(prices == no, 0.0)


def label_number(text: Column | str) -> Column:
    """Yes/No in any case, or a number that is exactly 0 or 1; null otherwise."""
    word = F.lower(F.trim(_col(text)))
    number = word.try_cast("double")
    return (
        F.when(word == "yes", 1.0)
        .when(word == "no", 0.0)
        .when(number.isin(0.0, 1.0), number + F.lit(0.0))
    )


def agreed_label(explicit: Column, prices: Column) -> Column:
    """Label from an explicit value and a price list; null when both exist and differ."""
    stated = label_number(explicit)
    listed = terminal_label(F.transform(json_list(prices), lambda x: x.try_cast("double")))
    absent = F.lit("")
    no_stated = F.coalesce(explicit, absent) == ""
    no_listed = F.coalesce(prices, absent) == ""
    return (
        F.when(no_stated & no_listed, None)
        .when(no_stated, listed)
        .when(no_listed, stated)
        .when(stated == listed, stated)
    )


def page_request_ok(url: Column | str, endpoint: str, title_search: str) -> Column:
    """Event page URL: declared endpoint, exact query fields once each, window up to a day."""
    url = _col(url)
    query = F.try_parse_url(url, F.lit("QUERY"))
    pairs = F.split(query, "&")
    names = F.transform(pairs, lambda x: F.substring_index(x, "=", 1))
    required = F.array(*[F.lit(f) for f in PAGE_FIELDS])
    extra = F.array_except(names, required)

    def value(name: str) -> Column:
        own = F.filter(pairs, lambda x: F.startswith(x, F.lit(f"{name}=")))
        text = F.try_element_at(own, F.lit(1))
        return F.try_url_decode(F.substring(text, F.lit(len(name) + 2), F.length(text)))

    start, end = utc_timestamp(value("end_date_min")), utc_timestamp(value("end_date_max"))
    span = F.unix_micros(end) - F.unix_micros(start)
    return _true(
        (F.substring_index(url, "?", 1) == endpoint)
        & (F.instr(url, "#") == 0)
        & (F.size(F.array_distinct(names)) == F.size(names))
        & (F.size(F.array_except(required, names)) == 0)
        & (F.concat_ws(",", extra).isin("", CURSOR_FIELD))
        & ~F.exists(pairs, lambda x: ~x.rlike("^[^=]+=.+$"))
        & (value("closed") == "true")
        & (value("limit") == "100")
        & (value("title_search") == title_search)
        & (span > 0)
        & (span <= 86_400 * 1_000_000)
    )


def canonical_body(end_ts: Column, fidelity: Column, markets: Column, start_ts: Column) -> Column:
    """Compact JSON with sorted keys, the form whose digest is archived."""
    return F.to_json(
        F.struct(
            end_ts.alias("end_ts"),
            fidelity.alias("fidelity"),
            markets.alias("markets"),
            start_ts.alias("start_ts"),
        )
    )


def history_request_ok(
    body: Column | str, body_sha256: Column | str, fidelity: int, window_seconds: int
) -> Column:
    """History request body: exact fields, declared window, 1-20 distinct decimal tokens, digest."""
    body = _col(body)
    parsed = F.from_json(body, BODY_SCHEMA)
    tokens = parsed["markets"]
    keys = F.array_sort(F.json_object_keys(body))
    canonical = canonical_body(
        parsed["end_ts"], parsed["fidelity"], tokens, parsed["start_ts"]
    )
    return _true(
        (F.concat_ws(",", keys) == "end_ts,fidelity,markets,start_ts")
        & (parsed["end_ts"] - parsed["start_ts"] == window_seconds)
        & (parsed["start_ts"] >= 0)
        & (parsed["fidelity"] == fidelity)
        & F.size(tokens).between(1, MAX_TOKENS_PER_REQUEST)
        & (F.size(F.array_distinct(tokens)) == F.size(tokens))
        & ~F.exists(tokens, lambda t: ~decimal_text(t))
        & (F.sha2(canonical, 256) == _col(body_sha256))
    )


def safe_archive_path(path: Column | str, folder: Column | str) -> Column:
    """Relative ``raw/<folder>/...json.gz`` path without empty, dot or parent parts."""
    path, folder = _col(path), _col(folder)
    inside = F.startswith(path, F.concat(F.lit("raw/"), folder, F.lit("/")))
    odd = path.rlike(r"(^|/)(\.{0,2})(/|$)")
    return _true(inside & ~odd & F.endswith(path, F.lit(".json.gz")))
