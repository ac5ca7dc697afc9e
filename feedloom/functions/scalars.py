"""Scalar expressions: coercions, fallbacks, classifiers, dates and formats. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grades of interest and their rank, fetch steps in order, steps that call a model.
GRADES = {"***": 3, "**": 2, "*": 1}
FETCH_STEPS = ["hatena", "hn", "reddit", "security_blogs", "rss"]
# What errors say whose connection was refused, whose reply can't be read, and which replies were empty.
REFUSED, PARSE_WORDS, UNREADABLE, NOTHING = ["connection refused", "errno 61", "errno 111"], ["parse_llm_json", "json"], "無法解析", ["''", '""', "空"]
# Names of sources whose items have no label of their own.
SOURCE_NAMES = {"hatena": "Hatena", "hn": "HN", "reddit": "Reddit", "security": "Security", "rss": "RSS"}
# Form of a mail date (weekday, day, month, year, time, zone), and the zones with a name.
MAIL_DATE = r"(?i)^\s*(?:[a-z]{3},?\s+)?(\d{1,2})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+([a-z]+|[+-]\d{4}))?\s*$"
MAIL_ZONES = {"UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00", "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}


def strip(text: Column) -> Column:
    """White space of any script off both ends (trim takes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def truthy(column: Column, kind: str = "string") -> Column:
    """The value, or null where it counts as missing: null, '', 0."""
    return F.nullif(column, F.lit("")) if kind == "string" else F.nullif(column, F.lit(0))


def first_truthy(*columns: Column, default=None, kind: str = "string") -> Column:
    picks = [truthy(c, kind) for c in columns]
    return F.coalesce(*picks, F.lit(default)) if default is not None else F.coalesce(*picks)


def interest_rank(interest: Column) -> Column:
    """Rank of a grade; a missing grade counts as '*', an unknown one as 0."""
    out = F.when(interest.isNull(), 1)
    for grade, rank in GRADES.items():
        out = out.when(interest == grade, rank)
    return out.otherwise(0)


def threshold_rank(grade: str) -> int:
    """Rank of a threshold; an unknown threshold counts as '**'."""
    return GRADES.get(grade, GRADES["**"])


def coerce_int(text: Column) -> Column:
    """Integer of a JSON scalar given as raw text: digits after stripping, floats cut towards zero, else 0 (also true, '--5')."""
    bare = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r'^"|"$', ""))
    whole = F.when(bare.rlike(r"^-?[0-9]{1,18}$"), F.try_to_number(bare, F.lit("S999999999999999999")).cast("long"))
    number = F.when(~text.rlike('^"') & bare.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), bare.try_cast("double").cast("long"))
    return F.coalesce(whole, number, F.lit(0).cast("long"))


def number_or_null(value: Column) -> Column:
    """Double of a VARIANT number; null of booleans, text, and everything else."""
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), F.try_variant_get(value, "$", "double"))


def classify_error(error: Column) -> Column:
    """Error class of a message; the first that fits. Only what the classes name counts: a message that merely mentions a
    time-out, a status or a number is 'other'."""
    text = F.coalesce(error, F.lit(""))
    low = F.lower(text)
    holds = lambda where, words: F.greatest(*[F.contains(where, F.lit(w)) for w in (*words, words[0])])
    reply = holds(low, PARSE_WORDS) | F.contains(text, F.lit(UNREADABLE))
    return (
        F.when(holds(low, REFUSED), "network").when(F.contains(low, F.lit("http error")), "upstream_http").when(F.contains(low, F.lit("urlopen error")), "network")
        .when(reply & holds(text, NOTHING), "empty_llm").when(reply, "parse").otherwise("other"))


def classify_url(url: Column, exact_host: bool = False) -> Column:
    """twitter, hn (an item), reddit (a thread) or general, case-sensitive; with exact_host a host that merely ends like
    another isn't taken for it."""
    u = F.coalesce(url, F.lit(""))
    at = (lambda host, rest="": u.rlike(r"^[a-z]+://(?:[^/?#@]*@)?(?:[^/?#]*\.)?" + host + rest)) if exact_host else (lambda host, rest="": u.rlike(host + rest))
    return (
        F.when(at(r"x\.com/") | at(r"twitter\.com/"), "twitter").when(at(r"news\.ycombinator\.com/", r"item\?id="), "hn")
        .when(at(r"reddit\.com/", "r/") & F.contains(u, F.lit("/comments/")), "reddit").otherwise("general"))


def is_valid_url(url: Column) -> Column:
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def clean_comment(text: Column, cap: int = 60) -> Column:
    """Cap first, then tags, markdown links, bare addresses and fences off, then strip."""
    out = strip_tags(F.substring(F.coalesce(text, F.lit("")), 1, cap))
    for pattern, to in ((r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"https?://\S+", ""), ("```", "")):
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def strict_date(text: Column) -> Column:
    """Date of exactly YYYY-MM-DD, else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


def loose_date(text: Column) -> Column:
    """Date of YYYY-M-D with or without leading zeros, else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), text.try_cast("date"))


def day_number(date: Column) -> Column:
    """Days since 0001-01-01, counted from 1."""
    return F.unix_date(date) + 719163


def mail_date(text: Column) -> Column:
    """ISO form of an RFC 2822 date with its own offset; without one where the date has none, an unknown one or -0000. Text
    that isn't such a date stays as it is; null and empty become empty."""
    part = lambda i: F.regexp_extract(text, MAIL_DATE, i)
    stamp = F.try_to_timestamp(F.concat_ws(" ", part(1), F.initcap(part(2)), part(3), F.concat(F.lpad(part(4), 2, "0"), F.lit(":"), part(5), F.lit(":"), F.when(part(6) == "", "00").otherwise(part(6)))), F.lit("d MMM yyyy HH:mm:ss"))
    names = F.create_map(*[F.lit(x) for pair in MAIL_ZONES.items() for x in pair])
    zone = F.upper(part(7))
    offset = F.when(zone.rlike(r"^[+-]\d{4}$") & (zone != "-0000"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise(F.coalesce(F.try_element_at(names, zone), F.lit("")))
    return F.coalesce(F.when(text.rlike(MAIL_DATE), F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), offset)), text, F.lit(""))


def usage_total(prompt: Column, completion: Column, total: Column) -> Column:
    """Total tokens; 0 or null falls back to the sum of the parts."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.when(zero(total) != 0, total).otherwise(zero(prompt) + zero(completion))


def duration_text(seconds: Column) -> Column:
    """'—' of nothing, minutes below an hour, else h:mm."""
    s = F.coalesce(seconds, F.lit(0.0))
    minutes = F.floor(s / 60)
    return F.when(s <= 0, "—").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(
        F.concat(F.floor(minutes / 60).cast("string"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0")))


def token_text(tokens: Column) -> Column:
    """Tokens in millions with two digits, or thousands with none, or as they are; '—' of nothing."""
    size = lambda d, n: F.format_string(f"%.{n}f", F.bround(tokens / d, n))
    return F.when(tokens.isNull(), "—").when(tokens >= 1_000_000, F.concat(size(1e6, 2), F.lit("M"))).when(tokens >= 1000, F.concat(size(1e3, 0), F.lit("K"))).otherwise(tokens.cast("long").cast("string"))


def fixed_text(number: Column, digits: int = 1) -> Column:
    """A number from -4095 to 4095 with so many digits, rounded by its exact binary value, exact halves to the even digit."""
    one, ten = 1 << 50, 10 ** digits
    exact = F.abs(number * float(one))  # a power of two, so nothing is rounded
    scaled = exact.cast("long")
    finer = (exact - scaled) * ten
    part = scaled.bitwiseAND(F.lit(one - 1)) * ten + F.floor(finer)
    digit, rest = F.shiftright(part, 50), part.bitwiseAND(F.lit(one - 1))
    up = (rest > one // 2) | ((rest == one // 2) & ((finer > F.floor(finer)) | (digit % 2 == 1)))
    total = F.shiftright(scaled, 50) * ten + digit + up.cast("long")
    return F.concat(F.when(number < 0, "-").otherwise(""), F.floor(total / ten).cast("string"), F.lit("."), F.lpad((total % ten).cast("string"), digits, "0"))


def score_text(score: Column) -> Column:
    """A score (0 to 4095) with one digit; '—' of none."""
    return F.when(score.isNull(), "—").otherwise(fixed_text(score))


def thousands(number: Column) -> Column:
    """An integer with commas between thousands."""
    return F.format_number(number, 0)


def link_token(number: Column) -> Column:
    return F.concat(F.lit("@@"), number.cast("string"), F.lit("@@"))


def response_text(content: Column, reasoning: Column, structured: Column) -> Column:
    """Content; the reasoning only where the reply was constrained and the content is blank."""
    blank = strip(F.coalesce(content, F.lit(""))) == ""
    return F.when(blank & structured, F.coalesce(reasoning, F.lit(""))).otherwise(F.coalesce(content, F.lit("")))


def run_verdict(in_steps: Column, exists: Column, forced: Column, upstream_ran: Column) -> Column:
    """RUN, LOAD or SKIP of a step: outside the wanted steps it loads what exists; inside it runs if forced, stale or absent."""
    return F.when(~in_steps, F.when(exists, "LOAD").otherwise("SKIP")).when(forced | upstream_ran | ~exists, "RUN").otherwise("LOAD")


def safe_path(path: Column) -> Column:
    """A relative path without '.', '..' and doubled slashes; null where it is absolute or would leave its folder."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    left = F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok")), lambda s, x: F.when(x != "..", F.struct(F.concat(s["at"], F.array(x)).alias("at"), s["ok"].alias("ok"))).when(
        F.size(s["at"]) > 0, F.struct(F.slice(s["at"], F.lit(1), F.size(s["at"]) - 1).alias("at"), s["ok"].alias("ok"))).otherwise(F.struct(s["at"].alias("at"), F.lit(False).alias("ok"))))
    return F.when(left["ok"] & ~path.startswith("/") & (F.size(left["at"]) > 0), F.array_join(left["at"], "/"))


def source_label(subreddit: Column, source: Column, key: Column) -> Column:
    """What a source is called: its subreddit, else its own label, else the name of its key, else the key."""
    names = F.create_map(*[F.lit(x) for pair in SOURCE_NAMES.items() for x in pair])
    return F.coalesce(truthy(subreddit), truthy(source), F.try_element_at(names, key), key)


def trigger(arguments: Column) -> Column:
    """manual where a run was called with flags, else scheduled."""
    return F.when(strip(arguments).startswith("-") | F.contains(F.concat(F.lit(" "), arguments), F.lit(" -")), "manual").otherwise("scheduled")


def merged_map(left: Column, right: Column) -> Column:
    """Entries of both maps; of a key in both, the right one. Null counts as empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
