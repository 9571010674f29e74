"""Inputs derived from the given tables, by SQL that both engines read the same way.

Every credential is synthetic: it comes from the md5 of a row's id. Nothing is left out of a
table: each row of it becomes a row here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

H = "md5(cast(doc_id as string))"
H2 = "md5(concat('b', cast(doc_id as string)))"
NL = "chr(10)"
DQ = "chr(34)"
SQ = "chr(39)"
BT = "chr(96)"
DOLLAR = "chr(36)"


def _cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _q(text: str) -> str:
    return "'" + text + "'"


def _assign(left: str, value: str, quote: str = DQ) -> str:
    return _cat(_q(left), quote, value, quote, "';'")


# One planted text per remainder of doc_id.
PLANTED = [
    _cat("'const id = '", SQ, "'AKIA'", f"upper(substr({H}, 1, 16))", SQ),
    _cat("'near miss AKIA'", f"upper(substr({H}, 1, 15))", "' end'"),
    _cat("'é'", "'AKIA'", f"upper(substr({H}, 1, 16))", "'é'"),
    _cat("'token: ghp_'", H, f"substr({H2}, 1, 4)"),
    _cat("'github_pat_'", f"substr({H}, 1, 22)", "'_'", H, f"substr({H2}, 1, 27)"),
    _cat("'stripe('", SQ, "'sk_live_'", H, SQ, "')'"),
    _cat("'sk_test_'", H, NL, "'again '", "'sk_test_'", H, NL),
    _cat("'xoxb-123456789012-210987654321-'", f"substr({H}, 1, 24)"),
    _cat("'jwt eyJ'", H, "'.eyJ'", H2, "'.'", H),
    _cat("'-----BEGIN RSA PRIVATE KEY-----'", NL, H, NL, H2, NL, "'-----END RSA PRIVATE KEY-----'"),
    _assign("kms encryption key = ", f"repeat('A', 40 + doc_id % 7)"),
    _assign("openai api key: ", H),
    _assign("OPENAI_API_KEY=", H, SQ),
    _cat("'DefaultEndpointsProtocol=https;AccountName=acct1;AccountKey='", H, H2, f"substr({H}, 1, 22)", "'=='"),
    _cat("'dop_v1_'", H, H2),
    _cat("'key=AIza'", f"substr({_cat(H, H2)}, 1, 35)"),
    _cat("'https://discord.com/api/webhooks/123456789012345678/'", H, H2),
    _cat("'AC'", H, "' and SK'", H2),
    _cat("'mongodb://svc:'", f"substr({H}, 1, 12)", "'@db.internal:27017/app'"),
    _cat("'postgres://svc:'", f"substr({H}, 1, 12)", "'@db.internal/app'", NL, "'mysql://svc:'", H2, "'@db2/app'"),
    _cat("'dckr_pat_'", f"substr({H}, 1, 27)"),
    _cat("'access_token'", DOLLAR, "'production'", DOLLAR, f"substr({H}, 1, 16)", DOLLAR, H2),
    _cat("'glpat-'", f"substr({H}, 1, 20)", NL, "'glrt-'", f"substr({H2}, 1, 20)"),
    _assign("auth0_client_secret = ", H),
    _cat("'hf_'", f"substr({_cat(H, H2)}, 1, 34)"),
    _assign("mysql password = ", _cat(DOLLAR, "'{MYSQL_PASSWORD}'")),
    _assign("postgres password: ", "'{{postgres_password}}'"),
    _cat("'arn:aws:iam::123456789012:role/'", f"substr({H}, 1, 9)"),
    _cat(H, f"upper({H2})", "'zyxwvutsrqponmlkjihgZYXWVUTSRQPONMLKJIHG'"),
    _assign("client_secret = ", H2, SQ),
    _cat("'mfa.'", H, H2, f"substr({H}, 1, 20)"),
    _cat("'stripe secret key = '", DQ, "'sk_live_'", H, DQ, NL, "'pk_live_'", H2),
    _cat("'ghp_'", f"substr({H}, 1, 30)", "' sk_live_'", f"substr({H}, 1, 9)", "' dop_v1_'", H, "' xoxb-1-2-3'", "' glpat-'", f"substr({H}, 1, 19)"),
    _cat("'AIza'", f"substr({H}, 1, 20)", "' mongodb://nobody@host'", "' AC'", f"substr({H}, 1, 31)", "' eyJ.eyJ.x'"),
    _cat("'SLACK signing secret: '", f"substr({H}, 1, 16)", f"substr({H}, 1, 16)"),
    _assign("digitalocean access token = ", H),
    "''",
    "''",
    "''",
    _cat("'password = '", SQ, f"substr({H}, 1, 10)", SQ, NL, "'password = '", SQ, f"substr({H}, 1, 10)", SQ),
]


def case_of(column: str, options: list[str]) -> str:
    arms = " ".join(f"when {i} then {option}" for i, option in enumerate(options))
    return f"case ({column}) % {len(options)} {arms} end"


FILES_SQL = f"""select concat('https://code.example.org/js/doc_', cast(doc_id as string), '.js') as url,
 concat('doc_', cast(doc_id as string), '.js') as file,
 concat(text, {NL}, {case_of('doc_id', PLANTED)}) as content,
 doc_id % 10 <> 9 as fetched, doc_id as doc_id
 from documents"""

_SUFFIXES = [
    "'/app.js'",
    "'/Main.JS'",
    "'/bundle.js?v=1'",
    "'/lib.js#x'",
    "'/lib%2ejs'",
    "'/index.html'",
    "'/a b.js'",
    "'/vendor/jquery-3.1.min.js'",
    "'/node_modules/x/y.js'",
    "'/js/sentry.bundle.js'",
    "'/bad%zz.js'",
    "'/'",
    "''",
    "concat('/', repeat('long', 60), '.js')",
    "'/we:ird|na*me__x.js'",
    "'/q.js?file=.css'",
    "'/%6A%73/app.min.js'",
    "'/x+y.js'",
]
_BARE_URL = "regexp_replace(url, '[?#].*', '')"
_ODD_URLS = [
    f"concat({_BARE_URL}, {case_of('page_id', _SUFFIXES)})",
    f"concat('  ', {_BARE_URL}, '/padded.js', chr(9))",
    "concat('https://cdn.jsdelivr.net/npm/pkg', cast(page_id as string), '/x.js')",
    "concat('https://host:port', cast(page_id as string), '/x.js')",
    "concat('/relative/', cast(page_id as string), '/x.js')",
    "concat('mailto:someone', cast(page_id as string), '@example.org')",
    "concat('https://user:pw@shop', cast(page_id % 50 as string), '.example.org:8443/app.js')",
    "concat('noscheme', cast(page_id as string), ':x/y.js')",
    "'   '",
    "concat('https://www.google-analytics.com/ga', cast(page_id as string), '.js')",
    "concat('https://static.example.org/', chr(233), 't', chr(233), cast(page_id as string), '.js')",
]
TOOLS = ("katana", "gau", "waybackurls")
# Each page's URL in one feed, and every other one in a second feed too.
URLS_SQL = f"""select {case_of('page_id', [_q(t) for t in TOOLS])} as tool,
 {case_of('page_id', _ODD_URLS)} as url, page_id as ord from pages
 union all
 select {case_of('page_id + 1', [_q(t) for t in TOOLS])} as tool,
 case when page_id % 2 = 0 then {case_of('page_id', _ODD_URLS)} else concat({_BARE_URL}, {case_of('page_id', _SUFFIXES)}) end as url,
 page_id + 1000000000 as ord from pages"""

PATHS = [
    "'/api/v1/users'",
    "'/v2/items/list'",
    "'/graphql'",
    "'login.php'",
    "'admin/run.action'",
    "'/a'",
    "'/ab'",
    "'/abc'",
    "'/abcd'",
    "'/store'",
    "'/draft'",
    "'//cdn/host/x'",
    "'/static-1.2/x'",
    "'/fonts/roman'",
    "'/assets/logo'",
    "'/content-page'",
    "'/lib/static-theme'",
    "'/x/node_modules/y'",
    f"concat('/', repeat('a', 199))",
    f"concat('/', repeat('a', 200))",
    f"repeat('/ab', 10)",
    f"repeat('/ab', 11)",
    "'/img/logo.png'",
    "'react.action'",
    "'click.do'",
    "'app.pl'",
    "'../up.py'",
    "'/rest/order-items_2/x'",
    "'/webhook'",
    "'/apivx'",
]


def _quoted(path_case: str, left: str, right: str) -> str:
    return f"concat({left}, {path_case}, {right})"


ENDPOINT_TEXTS_SQL = f"""select concat('page_', cast(page_id as string), '.html') as file,
 concat(html, {NL}, {_quoted(case_of('page_id', PATHS), DQ, DQ)}, {_quoted(case_of('page_id + 7', PATHS), SQ, BT)}, ' ',
 {_quoted(case_of('page_id + 13', PATHS), BT, DQ)}, ' and again ', {_quoted(case_of('page_id', PATHS), SQ, SQ)}) as content
 from pages"""

SCRIPT_PAGES_SQL = f"""select page_id, url, concat(html, {NL}, '<script src=', {DQ}, {case_of('page_id', [
    "'https://cdn.example.org/a.js'", "'//static.example.org/b.js?x=1'", "'/js/c.js'", "'d.js'", "'js/e.css'"])}, {DQ}, '></script>',
 '<SCRIPT>var n = ', cast(page_id as string), ';', {NL}, 'go();</SCRIPT><script> </script>') as html from pages"""

# References of every form, tags that are none, and a base on some pages.
REFERENCE_PAGES_SQL = f"""select page_id, concat(url, case page_id % 3 when 0 then '?page=1#top' else '' end) as url, concat(
 case page_id % 5 when 0 then '<BASE target=x HREF=/base/dir/file.html>' when 1 then '<base href="https://base.example.org">' else '' end, html, {NL},
 '<!-- <a href="hidden.js"> -->', '<a title=', {DQ}, '> src=no.js', {DQ}, ' href=', {DQ}, {case_of('page_id', [
    "'../up.js'", "'./x/./y.js?z=../1'", "'a/b/../../../../c.js'", "'//h.example.org/d.js'", "'?q=1'", "'#part'", "''", "'..'", "'/r/../s/./t.js#u'", "'.'",
    "'mailto:a@example.org'", "'https://e.example.org/../f.js'"])}, {DQ}, '><img src=unquoted.png/a alt=', {DQ}, {DQ},
 '><link href=', {DQ}, 'g.css?a=1&amp;b=&#47;&#x2F;&amp;lt;', {DQ}, '><p src><script>s = ', {DQ}, '<a href=q.js>', {DQ}, ';</script >', '<a data-href=n.js>')
 as html from pages"""

# Scripts that hold what looks like the end of one, or stand where none can.
SCRIPT_TEXTS_SQL = f"""select page_id, url, concat('<!-- <script>no();</script> ', case page_id % 2 when 0 then '--><script>' else '-><script>still no</script>--><SCRIPT async src=x>' end,
 html, '</script ><script type=', {DQ}, 'a>b', {DQ}, '><!--', {NL}, 'one(', cast(page_id as string), ');', {NL}, '--></script', {NL}, '>',
 '<p title=', {DQ}, '<script>quoted</script>', {DQ}, '><script/>two</script/><scripty>no</scripty><script>', {case_of('page_id', [
    "'var s = \"</scripts>\"; </script>'", "'open'", "' </script>'"])}) as html from pages"""

# A fetch log over the event table; the body size comes from the value.
FETCH_LOG_SQL = """select event_id as url_id,
 case event_id % 8 when 0 then 200 when 1 then 204 when 2 then 304 when 3 then 404 when 4 then 429 when 5 then 500
 when 6 then 503 else 504 end as status,
 case when event_id % 5 = 0 then cast(0 as bigint) else cast(floor(abs(value) * 1000 * (1 + event_id % 97)) as bigint) end as bytes,
 cast(event_id % 4 as int) as attempt from events"""

_FIRST_WORD = "substr(text, 1, instr(concat(text, ' '), ' ') - 1)"
# A rule table that grows with the documents: one user rule per document.
RULES_SQL = f"""select doc_id as ord, concat('rule-', cast(doc_id as string)) as rule_id, lang as category, source as provider,
 concat({_FIRST_WORD}, '[0-9]+') as regex,
 case doc_id % 11 when 0 then 'Token' when 1 then 'AAAA' when 2 then null when 3 then 'bearer' when 4 then 'abc' when 5 then 'éé'
 when 6 then 'stripe' else {_FIRST_WORD} end as keyword,
 case doc_id % 5 when 0 then '' when 1 then null when 2 then 'High' when 3 then 'low' else 'critical' end as severity,
 cast(case when doc_id % 7 = 1 then null else doc_id % 4 * 25 end as int) as confidence,
 split(concat(lang, ',', upper(source), ',', case doc_id % 3 when 0 then 'Token' when 1 then 'key' else lang end), ',') as tags,
 doc_id % 3 = 0 as entropy_check,
 cast(case when doc_id % 2 = 0 then 3.5 else 0.0 end as double) as min_entropy
 from documents"""

MANIFEST_LINES_SQL = f"""select case page_id % 5 when 0 then concat({_BARE_URL}, '/no bar here')
 when 1 then concat({_BARE_URL}, '|f', cast(page_id as string), '|x.js')
 when 2 then concat(url, '|old_', cast(page_id as string), '.js')
 else concat({_BARE_URL}, '|f', cast(page_id % 40 as string), '.js') end as value, page_id as ord from pages
 union all
 select concat(url, '|new_', cast(page_id as string), '.js') as value, page_id + 1000000000 as ord from pages where page_id % 5 = 2"""

# Every third URL is in the manifest; of the files it names, some are empty and some are gone.
MANIFEST_SQL = "select url, concat('f', cast(page_id as string), '.js') as filename from pages where page_id % 3 = 0"
STORED_SQL = """select concat('f', cast(page_id as string), '.js') as file,
 case when page_id % 4 = 0 then '' else html end as content from pages where page_id % 9 <> 0"""
PAGE_URLS_SQL = "select url, page_id as ord from pages"
PROCESSED_SQL = """select concat('doc_', cast(doc_id as string), '.js') as file,
 case when doc_id % 6 = 0 then '' else concat('processed ', text) end as content from documents where doc_id % 2 = 0"""
EXTERNAL_SQL = f"""select case page_id % 4 when 0 then concat('  /ext/', cast(page_id as string), ' ') when 1 then 'Running against: x'
 when 2 then '   ' else concat(url, '/full') end as value, concat('page_', cast(page_id as string), '.html') as file from pages"""

CONVERSATION_FILES_SQL = """select concat(cast(conv_id as string), '-', cast(turn as string)) as file,
 concat(text, case when conv_id % 3 = 0 then concat(' my token is ghp_', md5(text), 'abcd') else '' end) as content from conversations"""

TABLES = ("documents", "pages", "events", "conversations")


def derive(spark: SparkSession, sf_dir: str, sql: str, plants: DataFrame | None = None) -> DataFrame:
    """Run one of the statements above over the tables of ``sf_dir``."""
    bound = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES if f"from {name}" in sql}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in bound:
        sql = sql.replace(f"from {name}", f"from {{{name}}} as {name}")
    if plants is not None:
        bound["plants"] = plants
        sql = sql.replace("join plants", "join {plants} as plants")
    return spark.sql(sql, **bound)
