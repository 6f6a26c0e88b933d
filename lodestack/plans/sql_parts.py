"""Pieces of ANSI SQL that the oracle statements share."""

#: White space as the engine counts it, for engines whose \\s is ASCII only.
WS = r"[\t\n\x{000B}\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
RFC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def part(url: str, n: int) -> str:
    return f"regexp_extract({url}, '{RFC}', {n}, 's')"


def authority(url: str) -> str:
    return f"regexp_replace({part(url, 2)}, '^.*@', '')"


def host(url: str) -> str:
    return f"lower(regexp_replace(regexp_replace({authority(url)}, ':[0-9]*$', ''), '[\\[\\]]', '', 'g'))"


def domain(url: str) -> str:
    return f"coalesce(regexp_replace({host(url)}, '^www\\.', ''), '')"


def dedup_key(url: str) -> str:
    port = f"regexp_extract({authority(url)}, ':([0-9]+)$', 1)"
    path = f"regexp_replace({part(url, 3)}, '/+$', '')"
    return (
        f"(lower({part(url, 1)}) || '://' || {host(url)} || CASE WHEN {port} IN ('', '80', '443') THEN '' ELSE ':' || {port} END || "
        f"CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {part(url, 4)} = '' THEN '' ELSE '?' || {part(url, 4)} END)"
    )


def words(x: str) -> str:
    t = strip(x)
    return f"CASE WHEN {t} = '' THEN 0 ELSE len(string_split_regex({t}, '{WS}+')) END"


def lines(x: str) -> str:
    t = f"string_split_regex(coalesce({x}, ''), '\\r\\n|[\\n\\r\\x{{000B}}\\x{{000C}}\\x{{0085}}\\x{{2028}}\\x{{2029}}]')"
    return f"len(list_filter({t}, lambda v: {strip('v')} <> ''))"


def quality(table: str, key: str, text: str) -> str:
    return f"""
        WITH m AS (SELECT {key}, {strip(text)} AS t, {words(text)} AS w, {lines(text)} AS l FROM {table}),
        q AS (SELECT {key}, length(t) AS c, w, l, t, CASE WHEN l > 0 THEN w * 1.0 / l ELSE 0.0 END AS per FROM m),
        r AS (SELECT *, CASE WHEN t = '' THEN 'no extractable text'
              WHEN c < 500 THEN 'insufficient extractable content (' || c || ' characters)'
              WHEN w < 100 THEN 'insufficient extractable content (' || w || ' words)'
              WHEN l >= 10 AND per < 4.0 THEN 'page yielded navigation rather than content' ELSE '' END AS reason FROM q)
        SELECT {key}, reason = '' AS ok, reason, CAST(c AS INTEGER) AS char_count, CAST(w AS INTEGER) AS word_count, CAST(l AS INTEGER) AS line_count FROM r"""
