"""DuckDB text of the queries that SQL can say."""

from string import ascii_lowercase, ascii_uppercase

from loomwright.llm import mixing, repair, secret_scan, spelling, substrings

_WORD = mixing.WORD


def _base(kind: str, pattern: str, rank: int, value: bool) -> str:
    """Spans of one pattern: what lies between the matches and the matches, added up."""
    test = f"where length(v) >= {secret_scan.VALUE_AT_LEAST}" if value else ""
    group = f"regexp_extract_all(body, p, 2)" if value else "regexp_extract_all(body, p)"
    return f"""select doc_id, rid, '{kind}' as kind, {rank} as rank, beg, beg + length(m) as until from (
      select doc_id, rid, m, v, (sum(length(g) + length(m)) over (partition by rid order by k) - length(m))::bigint as beg from (
        select doc_id, rid, unnest(regexp_extract_all(body, p)) as m, unnest({group}) as v,
          unnest(string_split_regex(body, p)[1:len(regexp_extract_all(body, p))]) as g, unnest(range(len(regexp_extract_all(body, p)))) as k
        from (select *, $p${pattern}$p$ as p from docs) where regexp_matches(body, p))) {test}"""


def _dense(cls: secret_scan.CharClass, rank: int) -> str:
    costs = "[" + ", ".join(map(str, cls.costs)) + "]"
    allow = " or ".join(f"regexp_matches(s, '{p}')" for p in secret_scan.ALLOW)
    runs = _base("run", cls.pattern, 0, False).replace("select doc_id, rid, 'run'", "select m, doc_id, rid, 'run'", 1)
    return f"""select doc_id, rid, '{cls.name}' as kind, {rank} as rank, beg, until from (
      select doc_id, rid, run_at + min(w) as beg, run_at + max(w) + {cls.window} as until, substr(any_value(m), min(w)::int + 1, (max(w) + {cls.window} - min(w))::int) as s from (
        select *, sum(new) over (partition by rid, run_at order by w) as island from (
          select *, case when w - lag(w) over (partition by rid, run_at order by w) <= {cls.window} then 0 else 1 end as new from (
            select doc_id, rid, run_at, m, w, sum({costs}[n + 1]) as cost from (
              select doc_id, rid, run_at, any_value(m) as m, w, c, count(*) as n from (
                select *, unnest(string_split(substr(m, w::int + 1, {cls.window}), '')) as c from (
                  select doc_id, rid, beg as run_at, m, unnest(range(length(m) - {cls.window} + 1)) as w from ({runs})))
              group by doc_id, rid, run_at, w, c)
            group by doc_id, rid, run_at, m, w) where cost <= {cls.most}))
      group by doc_id, rid, run_at, island) where not ({allow})"""


def _secrets() -> str:
    base = " union all ".join(_base(k, p, r, k == "assign") for r, (k, p) in enumerate(
        zip(secret_scan.KINDS, (secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX))))
    more = " union all ".join(_dense(c, len(secret_scan.KINDS) + k) for k, c in enumerate(secret_scan.CLASSES))
    text = "string_agg(kind || ':' || beg || ':' || until, ',' order by beg, rank)"
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in secret_scan.KINDS)
    return f"""with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as body from documents),
    base as ({base}), spans as (select * from base union all {more}),
    b as (select rid, {counts}, {text} as s from base group by rid), a as (select rid, {text} as s from spans group by rid)
    select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
      sha256(coalesce(b.s, '')) as base_sha256, coalesce(a.s, '') as spans
    from docs d left join b on b.rid = d.rid left join a on a.rid = d.rid"""


def _mix() -> str:
    w = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
    return f"""with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as size from documents),
    s as (select source, sum(size)::bigint as source_size, {w}[((row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1)::int]::bigint as weight from d group by source),
    level as (
      select 0 as k, sum(source_size)::hugeint as rest, sum(weight)::hugeint as total from s
      union all
      select k + 1, (select sum(source_size) from s) - coalesce(c, 0), coalesce(t, 1) from (
        select k, any_value(l.rest) as rest, any_value(l.total) as total,
          sum(s.source_size * {mixing.REPEATS}) filter (s.source_size * {mixing.REPEATS} * l.total < s.weight * l.rest)::hugeint as c,
          sum(s.weight) filter (not (s.source_size * {mixing.REPEATS} * l.total < s.weight * l.rest))::hugeint as t
        from level l, s group by k)
      where coalesce(t, 1) <> total or (select sum(source_size) from s) - coalesce(c, 0) <> rest),
    last as (select rest, total from level order by k desc limit 1),
    t as (select source, source_size, case when source_size * {mixing.REPEATS} * total < weight * rest then (source_size * {mixing.REPEATS})::double
      else (weight * rest)::double / total::double end as target from s, last),
    r as (select d.*, source_size, target, case when source_size > 0 then target / source_size::double else 0.0 end as rate,
      ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / {float(1 << 52)} as u
      from d join t on d.source is not distinct from t.source)
    select doc_id, size::bigint as size, source_size, target, (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from r"""


#: Table of the CRC-32, by its polynomial, and the CRC of a list of bytes ``bytes`` with the table ``t``.
_CRC_TABLE = """list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
      lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end))"""
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _spelling() -> str:
    least, count, times = spelling.LEAST_LENGTH, spelling.LEAST_COUNT, spelling.TIMES
    return f"""with recursive runs as (select id, run, count(*) as times from (
      select coalesce(doc_id::varchar, 'null') as id,
        unnest(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[{spelling.LETTERS}]{{{least},}}')) as run from documents) group by all),
    hashed as (select run, times, {_CRC} as h from (select run, times, {_CRC_TABLE} as t, flatten(list_transform(string_split(id || ':' || run, ''),
      lambda c: case when ord(c) < 128 then [ord(c)] else [195, ord(c) - 64] end))::bigint[] as bytes from runs)),
    noisy as (select case when h % {spelling.FAULT_EVERY} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times from hashed),
    w as (select word, sum(times)::bigint as n from noisy where length(word) >= {least} group by word having sum(times) >= {count}),
    hole as (select word, n, unnest(range(1, length(word) + 1)) as i from w),
    cut as (select *, left(word, i - 1) as a, substr(word, i + 1) as b from hole),
    shorter as (select distinct c.word, c.n, w.word as near, w.n as near_n from cut c join w on w.word = c.a || c.b),
    pairs as (select x.word, x.n, y.word as near, y.n as near_n from cut x join cut y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
      union all select * from shorter union all select near, near_n, word, n from shorter),
    best as (select word, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from pairs group by word),
    formed as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= {times} * w.n then near end as form,
      case when near_n >= {times} * w.n then near_n end as form_n from w left join best using (word)),
    up as (select word, word as at from formed union all select up.word, f.form from up join formed f on f.word = up.at where f.form is not null),
    ends as (select up.word, up.at as root from up join formed f on f.word = up.at where f.form is null)
    select f.word, f.form, e.root, f.n, f.n_near, f.form_n from formed f join ends e using (word)"""


def _repair() -> str:
    """The search over rows and states, with whole edit strings."""
    r, white = repair, " || ".join(f"chr({ord(c)})" for c in repair.WHITE)
    inserts = [(a, b, k) for a in range(4) for b, k in [(a, 0), (r.ONWARD[a], 1), (r.ONWARD[r.ONWARD[a]], 2), (r.ONWARD[r.ONWARD[r.ONWARD[a]]], 3)]]
    places = [(a, "sua"[r.ONWARD[a] - 1], r.ONWARD[a], r.KEEP, 0) for a in range(4)] + [(r.START, "s", r.SYSTEM, r.KEEP, 0)]
    places += [(a, c, r.ONWARD[a], r.REROLE, r.REROLE_COST) for a in range(4) for c in "sua-" if c != "sua"[r.ONWARD[a] - 1]]

    def table(rows, names):
        return f"(values {', '.join(map(str, rows))}) as x({names})"

    return f"""with recursive d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, h % {r.DAMAGE_OF} as h from (
      select *, {_CRC} as h from (select *, {_CRC_TABLE} as t,
        list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ord(c))::bigint[] as bytes from conversations))),
    after as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then translate(text, '.!?', '') else text end as text
      from (select *, unnest(range(case when h = 3 then 2 else 1 end)) from d where h <> 0)),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, rtrim(text, {white}) as bare from after),
    rows as (select *, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else '-' end as c, lag(role) over w as before,
      case when bare = '' then 'b' when row_number() over (partition by conv_id, role, text order by k) > 1 then 'd' when right(bare, 1) in ('.', '!', '?') then '' else 't' end as f
      from placed window w as (partition by conv_id order by k)),
    sums as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (f = 'b') as blank, count(*) filter (f = 'd') as duplicate,
      count(*) filter (f = 't') as truncated, count(*) filter (before is not null and left(before, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal, count(*) as n from rows group by conv_id),
    ins as (select * from {table(inserts, "q, t, m")}), plc as (select * from {table(places, "t, c, z, e, cost")}),
    way as (
      select conv_id, 0::bigint as k, 0 as q, 0::bigint as cost, '' as audit from sums
      union all
      select conv_id, k, z, min({{'c': cost, 'a': audit}}).c, min({{'c': cost, 'a': audit}}).a from (
        select v.conv_id, v.k + 1 as k, z, v.cost + {r.INSERT_COST} * m + o.cost as cost, v.audit || repeat('{r.INSERT}', m) || e as audit
        from way v join ins i on i.q = v.q join rows x on x.conv_id is not distinct from v.conv_id and x.k = v.k + 1
        join lateral (select i.t as z, '{r.DELETE}' as e, {r.DELETE_COST} as cost
          union all select z, e, p.cost + case when x.f = 't' then {r.BROKEN_COST} else 0 end from plc p where p.t = i.t and p.c = x.c and x.f not in ('b', 'd')) o on true)
      group by conv_id, k, z),
    best as (select s.conv_id, min({{'c': v.cost + {r.INSERT_COST} * m, 'a': v.audit || repeat('{r.INSERT}', m)}}) as b
      from sums s join way v on v.conv_id is not distinct from s.conv_id and v.k = s.n join ins i on i.q = v.q where i.t in {r.ENDS} group by s.conv_id),
    letters as (select *, count(*) filter (e <> '{r.INSERT}') over w as k, count(*) filter (e <> '{r.DELETE}') over w - 1 as o, count(*) filter (e <> '{r.DELETE}') over (partition by conv_id) % 2 as odd
      from (select conv_id, unnest(string_split(b.a, '')) as e, unnest(range(1, length(b.a) + 1)) as j from best where b.a <> '') window w as (partition by conv_id order by j)),
    whole as (select l.conv_id, sha256(string_agg(case when e = '{r.KEEP}' then x.role when (o - odd) % 2 = 0 then 'user' else 'assistant' end || ':' || case when e = '{r.INSERT}' then '' else x.text end, chr(10) order by j)) as h
      from letters l left join rows x on x.conv_id is not distinct from l.conv_id and x.k = l.k where e <> '{r.DELETE}' group by l.conv_id)
    select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
      coalesce(illegal, 0)::bigint as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, coalesce(h, sha256('')) as repaired_sha256
    from (select distinct conv_id from conversations) c left join sums s on s.conv_id is not distinct from c.conv_id
    left join best on best.conv_id is not distinct from c.conv_id left join whole w on w.conv_id is not distinct from c.conv_id"""


def _components(links: str, nodes: str) -> str:
    """CTEs: ``reach`` (a, b), all nodes that links lead to from each node, itself included."""
    return f"reach as (select a, a as b from {nodes} union select r.a, l.b from reach r join {links} l on l.a = r.b)"


def _jaccard() -> str:
    return f"""with recursive w as (select row_number() over () as a, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{_WORD}') as w from documents),
    sets as (select distinct a, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
    size as (select a, count(*) as n from sets group by a),
    hits as (select x.a, y.a as b, count(*) as c from sets x join sets y on x.s = y.s and x.a <> y.a group by x.a, y.a),
    links as (select h.a, h.b from hits h join size m on m.a = h.a join size n on n.a = h.b where 100 * c >= 80 * (m.n + n.n - c)), {_components("links", "w")}
    select w.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(o.doc_id) as component_id
    from w left join size on size.a = w.a join reach r on r.a = w.a join w o on o.a = r.b group by w.a, w.doc_id"""


def _neardup() -> str:
    return f"""with recursive e as (select vec_id as a, embedding::double[] as v from embeddings),
    links as (select x.a, y.a as b from e x join e y on x.a <> y.a and list_cosine_similarity(x.v, y.v) >= 0.95), {_components("links", "e")},
    n as (select a, count(*) as n from links group by a)
    select e.a as vec_id, coalesce(any_value(n.n), 0)::bigint as n_links, min(r.b) as component_id, e.a = min(r.b) as kept from e join reach r on r.a = e.a left join n on n.a = e.a group by e.a"""


def _substrings() -> str:
    return f"""with w as (select row_number() over () as a, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
    win as (select a, doc_id, i, md5(array_to_string(w[i:i + {substrings.WINDOW - 1}], ' ')) as h from (select *, unnest(range(1, len(w) - {substrings.WINDOW - 2})) as i from w where len(w) >= {substrings.WINDOW})),
    late as (select a, i from win join (select h, min(doc_id) as least from win group by h) using (h) where doc_id > least),
    gone as (select distinct a, unnest(range(i, i + {substrings.WINDOW})) as k from late),
    each as (select a, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from w),
    kept as (select a, string_agg(word, ' ' order by k) as t from each anti join gone using (a, k) group by a)
    select w.doc_id, len(w.w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
    from w left join kept on kept.a = w.a left join (select a, count(*) as n from gone group by a) g on g.a = w.a"""


def _warc() -> str:
    return """select page_id, bytes as payload_bytes, sha1(body) as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then last end as refers_to
    from (select *, bytes >= 1000 and page_id < last as again from (select page_id, body, octet_length(encode(body))::bigint as bytes, max(page_id) over (partition by body) as last
      from (select page_id, coalesce(html, '') as body from pages)))"""


ORACLE = {"op1_secrets": _secrets(), "op2_mix": _mix(), "op3_jaccard": _jaccard(), "op4_substrings": _substrings(), "op8_warc": _warc(), "op9_neardup": _neardup(),
          "op12_spelling": _spelling(), "op13_repair": _repair()}
