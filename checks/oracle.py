"""The same questions as plain SQL, for the check engine. Rules appear in their original, untranslated text."""

from __future__ import annotations

from spillwatch.functions.keywords import COMMON_WORDS
from spillwatch.functions.urls import CDN_HOSTS, LIBRARY_NAMES, PACKAGE_FOLDER
from spillwatch.operators.endpoints import API_WORDS, ASSET_SUFFIXES, EVENT_NAMES, FRAMEWORKS, SERVER_SUFFIXES
from spillwatch.rules import RuleSet

from . import inputs as i


def q(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


# ------------------------------------------------------------------- secrets

ENTROPY = """select value, coalesce(-sum(n * 1.0 / strlen(value) * log2(n * 1.0 / strlen(value))), 0) as entropy from
 (select value, ch, count(*) as n from (select value, unnest(string_split(value, '')) as ch from {source}) group by value, ch)
 group by value"""


def _line(content: str, value: str) -> str:
    before = f"substr({content}, 1, instr({content}, {value}) - 1)"
    return f"cast(length({before}) - length(replace({before}, chr(10), '')) + 1 as integer)"


def not_placeholder(value: str) -> str:
    return (
        f"not (regexp_matches({value}, '(?s)[$][{{][^}}]*[}}]') or regexp_matches({value}, '(?s)[{{][{{][^}}]*[}}][}}]')"
        f" or regexp_matches({value}, '(?s)<your[^>]*>') or replace({value}, left({value}, 1), '') = '')"
    )


def found(rules: RuleSet, files: str = "files", distinct: bool = True, position: bool = False, strict: bool = False) -> str:
    """All matches of every rule on every file; ``strict``: of rules with a usable keyword only where it occurs as written."""

    def one(row):
        values = f"regexp_extract_all(content, {q(row['regex'])}, 0)"
        if distinct:
            values = f"list_distinct({values})"
        where = f" where contains(content, {q(row['keyword'])})" if strict and row["indexed"] else ""
        pos = f", cast(generate_subscripts({values}, 1) - 1 as integer) as pos" if position else ""
        return f"select file, cast({row['ord']} as integer) as ord, unnest({values}) as value{pos} from {files}{where}"

    return " union all ".join(one(row) for row in rules.rows)


def labels(rules: RuleSet) -> str:
    values = ",".join(
        f"({r['ord']},{r['rank']},{q(r['rule_id'])},{q(r['name'])},{q(r['severity'])},{r['confidence']},"
        f"{q('|'.join(r['tags']))},{str(r['entropy_check'] and r['min_entropy'] > 0).lower()},{r['min_entropy']},"
        f"{r['min_length']},{r['max_length'] or 2**31 - 1},{q('|'.join(r['context_keywords']))})"
        for r in rules.rows
    )
    return (
        f"select * from (values {values}) as t(ord, rank, rule_id, type, severity, confidence, tags, active, min_entropy,"
        " min_length, max_length, context)"
    )


def surviving(rules: RuleSet, files_sql: str = i.FILES_SQL, placeholders: bool = True, entropy: bool = True, strict: bool = False) -> str:
    """CTEs up to ``kept``: matches after the filters."""
    noise = not_placeholder("value") if placeholders else "true"
    random = "not active or entropy >= min_entropy" if entropy else "true"
    return f"""with files as materialized ({files_sql}),
 labels as materialized ({labels(rules)}),
 found as materialized ({found(rules, strict=strict)}),
 active as (select distinct value from found join labels using (ord) where active),
 entropies as materialized ({ENTROPY.format(source='active')}),
 kept as materialized (select file, value, rank, ord, active, min_length, max_length, context from found join labels using (ord)
  left join entropies using (value) where {noise} and ({random}))"""


def secrets(rules: RuleSet, files_sql: str = i.FILES_SQL, extra: str = "true", value: str = "value", strict: bool = False) -> str:
    """CTEs up to ``secrets``: findings, one per file and value."""
    return f"""{surviving(rules, files_sql, strict=strict)},
 firsts as (select file, value, min(rank) as rank from kept where {extra} group by file, value),
 secrets as materialized (select rule_id, type, {value} as value, file, {_line('content', 'firsts.value')} as line,
  concat('Template (', severity, ')') as detector, severity, cast(confidence as integer) as confidence, tags
  from firsts join labels using (rank) join files using (file))"""


SECRET_COLUMNS = "rule_id, type, value, file, line, detector, severity, confidence, tags"


def scan(rules: RuleSet, **kwargs) -> str:
    return f"{secrets(rules, **kwargs)} select {SECRET_COLUMNS} from secrets"


# ------------------------------------------------------------------- endpoints

_QUOTE = "[\"''`]"
PATTERNS = (
    rf"'{_QUOTE}(/[a-zA-Z0-9_/-]{{3,}}[a-zA-Z0-9_/]){_QUOTE}'",
    rf"'{_QUOTE}(/(?:{'|'.join(API_WORDS)}|v\d+)[a-zA-Z0-9_/-]*[a-zA-Z0-9_/]){_QUOTE}'",
    rf"'{_QUOTE}([a-zA-Z0-9_/-]+\.(?:{'|'.join(SERVER_SUFFIXES)})){_QUOTE}'",
)


def paths(n: int, source: str = "files") -> str:
    values = f"regexp_extract_all(content, {PATTERNS[n]}, 1)"
    return f"select file, cast(generate_subscripts({values}, 1) - 1 as integer) as pos, unnest({values}) as path from {source}"


GOOD_LENGTH = "strlen(path) >= 4 and strlen(path) <= 200"
GOOD_PREFIX = (
    "not starts_with(path, '//') and not starts_with(path, '/static-') and not starts_with(path, '/fonts/')"
    " and not starts_with(path, '/assets/')"
)
NOT_EXCLUDED = "not (" + " or ".join(
    f"regexp_matches(path, '{regex}')"
    for regex in (
        r"^\./[a-z-]+$",
        r"^\.\./[a-z-]+$",
        r"^[a-z]+\.[a-z]+$",
        rf"(?i)^({'|'.join(EVENT_NAMES)})\.",
        r"/static-\d+\.\d+",
        r"^/[a-z-]+/static-",
        r"^/(a|store|draft)$",
        rf"\.({'|'.join(ASSET_SUFFIXES)})$",
        rf"(?i)^({'|'.join(FRAMEWORKS)})\.",
        r"^/content-|^/browserslist-|^/head-|^/hub-",
    )
) + ")"
GOOD_SHAPE = (
    "not contains(lower(path), 'static-') and not contains(lower(path), 'node_modules')"
    " and length(path) - length(replace(path, '/', '')) <= 10"
)
ALL_PATHS = " union all ".join(f"select {n} as pattern, file, pos, path from ({paths(n)})" for n in range(3))


def endpoints(files_sql: str = i.ENDPOINT_TEXTS_SQL) -> str:
    """CTEs up to ``endpoints``."""
    return f"""with files as materialized ({files_sql}),
 endpoints as materialized (select distinct path, 'GET' as method, file, 'Regex' as source from ({ALL_PATHS})
  where {GOOD_LENGTH} and {GOOD_PREFIX} and {NOT_EXCLUDED} and {GOOD_SHAPE})"""


# ------------------------------------------------------------------- URLs

_NO_ESCAPES = "regexp_replace({0}, '%[0-9A-Fa-f][0-9A-Fa-f]', '', 'g')"


def url_parts(source: str, keep: str) -> str:
    """CTEs ``p1``..``parsed``: the pieces of ``url`` of every row of ``source``; ``keep`` lists its other columns."""
    bad = lambda c: f"contains({_NO_ESCAPES.format(c)}, '%')"
    return f"""p1 as (select {keep}, url, split_part(url, '#', 1) as base,
   case when contains(url, '#') then substr(url, instr(url, '#') + 1) else '' end as fragment from ({source})),
 p2 as (select *, regexp_extract(base, '(?s)^[A-Za-z][A-Za-z0-9+.-]*:', 0) as scheme from p1),
 p3 as (select *, split_part(substr(base, length(scheme) + 1), '?', 1) as rest from p2),
 p4 as (select *, starts_with(rest, '//') and (scheme <> '' or not starts_with(rest, '///')) as has_authority from p3),
 p5 as (select *, case when has_authority then split_part(substr(rest, 3), '/', 1) else '' end as authority from p4),
 p6 as (select *, case when scheme <> '' and not starts_with(rest, '/') then ''
   when has_authority then substr(rest, 3 + length(authority)) else rest end as raw_path,
   regexp_replace(authority, '(?s)^.*@', '') as raw_host, regexp_extract(authority, '(?s)^(.*)@', 1) as userinfo from p5),
 parsed as materialized (select {keep}, url, not (regexp_matches(url, '[\\x00-\\x1f\\x7f]') or starts_with(url, ':')
   or {bad('fragment')} or {bad('raw_path')} or {bad('raw_host')} or {bad('userinfo')}
   or (scheme = '' and not starts_with(rest, '/') and contains(split_part(rest, '/', 1), ':'))
   or regexp_matches(raw_host, ':[^:\\]]*[^0-9:\\]][^:\\]]*$')
   or not regexp_matches(raw_host, '^[A-Za-z0-9._~!$&''()*+,;=:\\[\\]<>"%\\x{{80}}-\\x{{10FFFF}}-]*$')
   or regexp_matches(replace(raw_host, '%25', ''), '%[0-7][0-9A-Fa-f]')
   or regexp_matches(userinfo, '[^A-Za-z0-9._:~!$&''()*+,;=%@-]')) as ok,
   url_decode(raw_path) as path, url_decode(raw_host) as host from p6)"""


IS_JS = "case when ok then ends_with(lower(path), '.js') else contains(url, '.js') end"


def _contains_any(words) -> str:
    return "(" + " or ".join(f"contains(lower(url), {q(w)})" for w in words) + ")"


IS_THIRD_PARTY = _contains_any((PACKAGE_FOLDER, *CDN_HOSTS, *LIBRARY_NAMES))
REASON = (
    f"case when {_contains_any([PACKAGE_FOLDER])} then 'package folder' when {_contains_any(CDN_HOSTS)} then 'cdn host'"
    f" when {_contains_any(LIBRARY_NAMES)} then 'library name' end"
)


def sanitized(name: str) -> str:
    cut = f"split_part({name}, '?', 1)"
    safe = f"""regexp_replace({cut}, '[<>:"/\\\\|*\\x00-\\x1f]', '_', 'g')"""
    return f"trim(regexp_replace({safe}, '_+', '_', 'g'), '. ')"


def filename(index: str) -> str:
    """From columns of ``parsed``."""
    base = "regexp_extract(regexp_replace(path, '/+$', ''), '(?s)[^/]*$', 0)"
    with_suffix = f"case when ends_with(lower({base}), '.js') then {base} else concat({base}, '.js') end"
    name = sanitized(f"({with_suffix})")
    # Names of the derived URLs are cut only where they are plain ASCII, so characters are bytes there.
    return f"""case when not ok then concat('file_', {index}, '_', left(md5(url), 16), '.js')
 when {base} in ('', '.') then concat(replace(host, '.', '_'), '_', {index}, '.js')
 when strlen({name}) > 200 then concat(left({name}, 180), '_', left(md5(url), 12), '.js') else {name} end"""


CLEAN = f"select tool, trim(url, concat(' ', chr(9), chr(10), chr(13))) as url, ord from ({i.URLS_SQL})"
CLEAN = f"select * from ({CLEAN}) where url <> ''"

# ------------------------------------------------------------------- rules

VALID_KEYWORD = (
    f"coalesce(strlen(keyword) >= 4 and lower(keyword) not in ({', '.join(map(q, COMMON_WORDS))})"
    " and not (replace(keyword, left(keyword, 1), '') = '' and strlen(left(keyword, 1)) = 1), false)"
)
OUTCOME = """case when status in (429, 503, 504) and attempt < 2 then 'retry' when status = 304 then 'not modified'
 when status < 200 or status >= 300 then 'failed' when bytes = 0 then 'empty' else 'success' end"""
