"""Queries of the text section."""

from pyspark.sql import functions as F

from loomwright.functions import text as FT
from loomwright.operators import text as T
from loomwright.operators.term_blocks import TermBlocks
from loomwright.queries.history import rounded
from loomwright.queries.registry import query
from loomwright.sources import table

C = F.col

# every clean-up rule is exercised by what goes before the text
_DECOR = """CASE doc_id % 4 WHEN 0 THEN 'See https://t.co/aB1?x=1 &amp; www.site.org/p now  ' WHEN 1 THEN '@user_1 says &lt;Hi&gt;, #Storm! &#233; ' WHEN 2 THEN E'A\\t&copy;2024 &amp;quot; ' ELSE '' END || text"""


def decorated(spark, d):
    doc = table(spark, d, "documents")
    head = (F.when(C("doc_id") % 4 == 0, "See https://t.co/aB1?x=1 &amp; www.site.org/p now  ")
            .when(C("doc_id") % 4 == 1, "@user_1 says &lt;Hi&gt;, #Storm! &#233; ").when(C("doc_id") % 4 == 2, "A\t&copy;2024 &amp;quot; ").otherwise(""))
    return doc.select("doc_id", "source", "n_chars", F.concat(head, "text").alias("text"))


def _unescape(x):
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#233;", "é"), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_U = r"https?://\S+|www\.\S+"


def light_sql(x):
    return f"trim(regexp_replace(regexp_replace({_unescape(x)}, '{_U}', ' ', 'g'), '{_WS}', ' ', 'g'))"


def full_sql(x):
    s = f"lower(regexp_replace({_unescape(x)}, '{_U}', ' ', 'g'))"
    s = f"replace(regexp_replace({s}, '@[\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g'), '#', ' ')"
    s = f"regexp_replace({s}, '[^a-z0-9#@!?''\\s]', ' ', 'g')"
    return f"trim(regexp_replace({s}, '{_WS}', ' ', 'g'))"


@query("txt_clean_light", f"SELECT 'd' || doc_id::VARCHAR AS id, md5({light_sql('(' + _DECOR + ')')}) AS clean FROM documents UNION ALL SELECT 'p' || page_id::VARCHAR, md5({light_sql('html')}) FROM pages")
def txt_clean_light(spark, d):
    docs = decorated(spark, d).select(F.concat(F.lit("d"), C("doc_id").cast("string")).alias("id"), "text")
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), C("page_id").cast("string")).alias("id"), C("html").alias("text"))
    return docs.unionByName(pages).select("id", F.md5(FT.clean_light("text")).alias("clean"))


@query("txt_clean_full", f"SELECT doc_id, {full_sql('(' + _DECOR + ')')} AS clean FROM documents")
def txt_clean_full(spark, d):
    return decorated(spark, d).select("doc_id", FT.clean_full("text").alias("clean"))


_KW = "CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'forest%20fire%C3%A9+' || page_id::VARCHAR || '%2F' || regexp_extract(url, '//([^/?#]+)', 1) END"


@query("txt_url_decode", f"SELECT page_id, coalesce(url_decode({_KW}), '') AS keyword FROM pages")
def txt_url_decode(spark, d):
    host = F.regexp_extract("url", "//([^/?#]+)", 1)
    kw = F.when(C("page_id") % 5 != 0, F.concat(F.lit("forest%20fire%C3%A9+"), C("page_id").cast("string"), F.lit("%2F"), host))
    return table(spark, d, "pages").select("page_id", FT.url_unquote(kw).alias("keyword"))


@query("txt_build_field", f"""SELECT doc_id, trim(regexp_replace(coalesce(CASE WHEN doc_id % 3 = 0 THEN replace(source || '%20fire', '%20', ' ') END, '') || ' ' || {full_sql('(' + _DECOR + ')')}, '{_WS}', ' ', 'g')) AS field FROM documents""")
def txt_build_field(spark, d):
    kw = F.when(C("doc_id") % 3 == 0, F.concat("source", F.lit("%20fire")))
    return decorated(spark, d).select("doc_id", T.build_field("text", kw).alias("field"))


@query("txt_counts", f"""SELECT doc_id, length(t)::INT AS char_len, len(list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> ''))::INT AS word_len, len(regexp_extract_all(t, '{_U}'))::INT AS n_url,
  len(regexp_extract_all(t, '@[\\p{{L}}\\p{{N}}\\p{{M}}_]+'))::INT AS n_mention, len(regexp_extract_all(t, '#[\\p{{L}}\\p{{N}}\\p{{M}}_]+'))::INT AS n_hashtag, (length(t) - length(replace(t, '!', '')))::INT AS n_exclaim FROM (SELECT doc_id, {_DECOR} AS t FROM documents)""")
def txt_counts(spark, d):
    return decorated(spark, d).select("doc_id", *[e.alias(n) for n, e in T.counts("text").items()])


_MARK = """CASE turn % 3 WHEN 0 THEN E'# Title 12\\n- one\\n  * two\\n```py\\nx = 34\\n```\\n' ELSE '' END || text"""


def marked(spark, d):
    head = F.when(C("turn") % 3 == 0, "# Title 12\n- one\n  * two\n```py\nx = 34\n```\n").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(head, "text").alias("text"))


_NAMES = ["char", "word", "avg_word", "newline", "code", "bullet", "header", "digit"]


def markers_sql(x):
    return {
        "char": f"length({x})::INT", "word": f"(length({x}) - length(replace({x}, ' ', '')) + 1)::INT", "avg_word": f"length({x}) / greatest(length({x}) - length(replace({x}, ' ', '')) + 1, 1)::DOUBLE",
        "newline": f"(length({x}) - length(replace({x}, chr(10), '')))::INT", "code": f"(len(regexp_extract_all({x}, '```')) // 2)::INT",
        "bullet": f"len(regexp_extract_all({x}, '(?m)^\\s*[-*]\\s'))::INT", "header": f"len(regexp_extract_all({x}, '(?m)^\\s*#{{1,6}}\\s'))::INT", "digit": f"len(regexp_extract_all({x}, '\\p{{Nd}}'))::INT"}


@query("txt_markers", f"SELECT conv_id, turn, {', '.join(f'{e} AS {n}' for n, e in markers_sql('t').items())} FROM (SELECT conv_id, turn, {_MARK} AS t FROM conversations)")
def txt_markers(spark, d):
    return marked(spark, d).select("conv_id", "turn", *[e.alias(n) for n, e in T.markers("text").items()])


def turn_pairs(spark, d):
    """Each user turn beside the assistant turn that follows it."""
    m = marked(spark, d)
    a = m.filter("role = 'user'").select("conv_id", "turn", C("text").alias("a"))
    b = m.filter("role = 'assistant'").select("conv_id", (C("turn") - 1).alias("turn"), C("text").alias("b"))
    return a.join(b, ["conv_id", "turn"])


_PAIR = f"""(SELECT a.conv_id, a.turn, a.t AS a, b.t AS b FROM (SELECT conv_id, turn, role, {_MARK} AS t FROM conversations) a JOIN (SELECT conv_id, turn, role, {_MARK} AS t FROM conversations) b
  ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


@query("txt_pair_diff_ratio", "SELECT conv_id, turn, " + ", ".join(
    f"({markers_sql('a')[n]}) - ({markers_sql('b')[n]}) AS diff_{n}, ({markers_sql('a')[n]})::DOUBLE / greatest({markers_sql('b')[n]}, 1)::DOUBLE AS ratio_{n}" for n in _NAMES) + f" FROM {_PAIR}")
def txt_pair_diff_ratio(spark, d):
    return T.pair_features(turn_pairs(spark, d), "a", "b", ["conv_id", "turn"])


@query("txt_split_parts", """SELECT c_custkey, substr(c_mktsegment, 1, 1) AS deck, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 1000 END::DOUBLE AS num, CASE WHEN c_nationkey % 2 = 0 THEN 'P' ELSE 'S' END AS side, string_split(c_name, '#')[1] AS grp FROM customer""")
def txt_split_parts(spark, d):
    c = table(spark, d, "customer")
    num = F.when(C("c_custkey") % 4 == 0, "n/a?").otherwise((C("c_custkey") % 1000).cast("string"))
    num = F.replace(num, F.lit("/"), F.lit("-"))
    cabin = F.concat_ws("/", F.substring("c_mktsegment", 1, 1), num, F.when(C("c_nationkey") % 2 == 0, "P").otherwise("S"))
    p = T.split_parts(cabin, "/", ["deck", "num", "side"])
    return c.select("c_custkey", p["deck"].alias("deck"), p["num"].try_cast("double").alias("num"), p["side"].alias("side"),
                    T.split_parts("c_name", "#", ["grp", "rest"])["grp"].alias("grp"))


@query("txt_last_token", "SELECT p_partkey, string_split(p_name, ' ')[-1] AS last_word, string_split(p_type || '_' || p_brand, '_')[-1] AS last_piece FROM part")
def txt_last_token(spark, d):
    return table(spark, d, "part").select("p_partkey", T.last_part("p_name", r"\s+").alias("last_word"),
                                          T.last_part(F.concat_ws("_", "p_type", "p_brand"), "_").alias("last_piece"))


@query("txt_format_id", "SELECT n_nationkey, 'clip_' || lpad(n_nationkey::VARCHAR, 4, '0') || '_class_' || n_regionkey::VARCHAR AS label_id FROM nation")
def txt_format_id(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.format_string("clip_%04d_class_%d", "n_nationkey", "n_regionkey").alias("label_id"))


_VOC = f"SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '{_WS}')) AS token FROM"


@query("txt_vocab_overlap", f"""WITH a AS (SELECT token FROM ({_VOC} documents) WHERE token <> ''), b AS (SELECT token FROM ({_VOC} benchmark) WHERE token <> '')
  SELECT count(*) AS n_tokens, count(*) FILTER (token NOT IN (SELECT token FROM a)) AS n_unseen, count(*) FILTER (token NOT IN (SELECT token FROM a)) / count(*)::DOUBLE AS unseen_share FROM b""")
def txt_vocab_overlap(spark, d):
    return T.vocab_overlap(table(spark, d, "documents"), table(spark, d, "benchmark"), "text")


def _summary(w):
    total = F.aggregate("weight", F.lit(0.0), lambda s, x: s + x)
    return rounded(w.select("doc_id", F.size("weight").cast("long").alias("n_terms"), total.alias("total"), F.array_max("weight").alias("top")), 6)


_TFIDF = """, dfs AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) >= {m}){feat}, raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN {src} USING (term)),
  u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw) SELECT doc_id, count(*) AS n_terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS top FROM u GROUP BY 1"""


@query("txt_tfidf_word", """WITH w AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2)""" + _TFIDF.format(m=3, feat="", src="dfs"))
def txt_tfidf_word(spark, d):
    return _summary(TermBlocks(table(spark, d, "documents"), "doc_id", "text", ["word"]).tfidf({"word": 3}))


_GRAM = "[" + ", ".join(f"CASE WHEN length(w) >= {n} THEN list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n})) ELSE [] END" for n in (3, 4, 5)) + "]"


@query("txt_tfidf_char", f"""WITH k AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{_WS}')) AS t FROM documents), p AS (SELECT doc_id, ' ' || t || ' ' AS w, count(*) AS n FROM k WHERE t <> '' GROUP BY 1, 2),
  g AS (SELECT doc_id, n, unnest(flatten({_GRAM})) AS term FROM p), tf AS (SELECT doc_id, term, sum(n) AS tf FROM g GROUP BY 1, 2)""" + _TFIDF.format(m=3, feat="", src="dfs"))
def txt_tfidf_char(spark, d):
    return _summary(TermBlocks(table(spark, d, "documents"), "doc_id", "text", ["char"]).tfidf({"char": 3}))


SVD_DIMS = 64


@query("txt_svd")
def txt_svd(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "text")
    out = T.svd_embed(TermBlocks(doc, "doc_id", "text", ["word"]).tables(3)[0], "doc_id", SVD_DIMS)
    return out.select("doc_id", *[F.get("v", F.lit(i)).alias(f"svd_{i}") for i in range(SVD_DIMS)])


@query("txt_svd_pairs")
def txt_svd_pairs(spark, d):
    """Each conversation's first text as prompt, the next two as answers."""
    c = table(spark, d, "conversations").filter("turn < 3").groupBy("conv_id").agg(
        *[F.max(F.when(C("turn") == t, C("text"))).alias(n) for t, n in enumerate("pab")])
    out = T.pair_block(c, "conv_id", SVD_DIMS)
    return out.select("conv_id", *[F.get(s, F.lit(i)).alias(f"svd_{s}{i}") for s in "abdp" for i in range(SVD_DIMS)], "cos_ab", "cos_pa", "cos_pb")


def vector_pairs(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", C("embedding").alias("a"))
    return e.join(e.select((C("vec_id") - 1).alias("vec_id"), C("a").alias("b")), "vec_id")


_VP = "(SELECT x.vec_id, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"


@query("txt_cosine", f"SELECT vec_id, round(list_cosine_similarity(a::DOUBLE[], b::DOUBLE[]), 7) + 0.0 AS cosine FROM {_VP}")
def txt_cosine(spark, d):
    return rounded(vector_pairs(spark, d).select("vec_id", T.cosine("a", "b").alias("cosine")), 7)


@query("txt_vec_diff", f"SELECT vec_id, (i - 1)::INT AS pos, a[i]::DOUBLE - b[i]::DOUBLE AS diff FROM {_VP}, range(1, 65) t(i)")
def txt_vec_diff(spark, d):
    return vector_pairs(spark, d).select("vec_id", F.posexplode(T.vector_difference("a", "b")).alias("pos", "diff"))


def turn_cells(spark, d):
    """Packed JSON cells: a list with a non-string entry, a broken cell, a bare string."""
    c = table(spark, d, "conversations")
    key = C("conv_id") * 10 + C("turn")
    quoted = F.concat(F.lit('"'), C("role"), F.lit('"'))
    cell = (F.when(key % 5 == 0, F.concat(F.lit("[broken "), "role")).when(key % 5 == 1, quoted)
            .when(key % 5 == 2, F.concat(F.lit("["), quoted, F.lit(", null, 7]"))).otherwise(F.to_json(F.array("role", "text"))))
    turns = c.select("conv_id", "turn", cell.alias("cell"))
    props = table(spark, d, "events").select((-C("event_id") - 1).alias("conv_id"), F.lit(0).cast("long").alias("turn"), C("props").alias("cell"))
    return turns.unionByName(props)


_CELLS = """(SELECT conv_id, turn, CASE (conv_id * 10 + turn) % 5 WHEN 0 THEN ['[broken ' || role] WHEN 1 THEN [role] WHEN 2 THEN [role, '', ''] ELSE [role, text] END AS turns FROM conversations
  UNION ALL SELECT -event_id - 1, 0, [props] FROM events)"""


@query("json_turns", f"SELECT conv_id, turn, (generate_subscripts(turns, 1) - 1)::INT AS pos, unnest(turns) AS piece FROM {_CELLS}")
def json_turns(spark, d):
    return turn_cells(spark, d).select("conv_id", "turn", F.posexplode(T.parse_turns("cell")).alias("pos", "piece"))


@query("json_join_turns", f"SELECT conv_id, turn, array_to_string(turns, chr(10) || chr(10)) AS text, len(turns)::INT AS n_turns FROM {_CELLS}")
def json_join_turns(spark, d):
    t = turn_cells(spark, d).select("conv_id", "turn", T.parse_turns("cell").alias("turns"))
    return t.select("conv_id", "turn", T.join_turns("turns").alias("text"), F.size("turns").alias("n_turns"))


def tok_sql(x):
    return f"list_filter(regexp_split_to_array({x}, '{_WS}'), lambda x: x <> '')"


def _ht(x, b):
    return f"CASE WHEN len({x}) <= {b} THEN {x} ELSE list_concat({x}[1:{b // 2}], {x}[-{b - b // 2}:]) END"


@query("arr_head_tail", f"SELECT doc_id, len({_ht('t', 31)})::INT AS n, array_to_string({_ht('t', 31)}, ' ') AS kept FROM (SELECT doc_id, {tok_sql('text')} AS t FROM documents)")
def arr_head_tail(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.head_tail(FT.words("text"), 31).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("kept"))


@query("arr_pack_fields", f"""SELECT conv_id, turn, array_to_string(list_concat(list_concat(list_concat(['[CLS]'], {_ht('p', 11)}), ['[SEP]']), list_concat(list_concat({_ht('a', 16)}, ['[SEP]']), list_concat({_ht('b', 16)}, ['[SEP]'])))[1:48], ' ') AS packed FROM
  (SELECT conv_id, turn, {tok_sql("'Prompt: ' || conv_id::VARCHAR || ' ' || turn::VARCHAR")} AS p, {tok_sql("'Response A: ' || a")} AS a, {tok_sql("'Response B: ' || b")} AS b FROM {_PAIR})""")
def arr_pack_fields(spark, d):
    p = turn_pairs(spark, d)
    prompt = F.concat_ws(" ", C("conv_id").cast("string"), C("turn").cast("string"))
    # a quarter of the room for the prompt, the rest in halves
    fields = [T.Field(m, t, s) for m, t, s in zip(T.FIELD_MARKS, (prompt, C("a"), C("b")), (2, 3, 3))]
    return p.select("conv_id", "turn", F.array_join(T.assemble(fields, 48), " ").alias("packed"))


_REPLY = """CASE (conv_id + turn) % 6 WHEN 0 THEN '{"label": 1} ' || text WHEN 1 THEN 'answer 0 or 1 ' || role WHEN 2 THEN 'Not a Disaster' WHEN 3 THEN ' a real one ' || role WHEN 4 THEN '' ELSE text END"""


@query("txt_parse_label", f"""SELECT conv_id, turn, CASE WHEN s = '' THEN NULL WHEN regexp_matches(s, '"?label"?\\s*[:=]\\s*[01]') THEN regexp_extract(s, '"?label"?\\s*[:=]\\s*([01])', 1)::INT WHEN len(regexp_extract_all(s, '\\b([01])\\b', 1)) > 0 THEN regexp_extract_all(s, '\\b([01])\\b', 1)[-1]::INT
  WHEN contains(lower(s), 'not') OR contains(lower(s), 'non-disaster') OR contains(lower(s), 'no disaster') THEN 0 WHEN contains(lower(s), 'disaster') OR contains(lower(s), 'real') THEN 1 END AS label FROM (SELECT conv_id, turn, trim({_REPLY}) AS s FROM conversations)""")
def txt_parse_label(spark, d):
    k = (C("conv_id") + C("turn")) % 6
    reply = (F.when(k == 0, F.concat(F.lit('{"label": 1} '), "text")).when(k == 1, F.concat(F.lit("answer 0 or 1 "), "role")).when(k == 2, "Not a Disaster")
             .when(k == 3, F.concat(F.lit(" a real one "), "role")).when(k == 4, "").otherwise(C("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", T.parse_label(reply).alias("label"))


@query("txt_prompt_message", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Keyword: ' || source || ' fire' || chr(10) ELSE '' END || 'Tweet: ' || text || chr(10) || 'Answer (1 or 0):' AS message FROM documents""")
def txt_prompt_message(spark, d):
    kw = F.when(C("doc_id") % 3 == 0, F.concat("source", F.lit("%20fire")))
    return table(spark, d, "documents").select("doc_id", T.prompt_message(kw, "text").alias("message"))


@query("txt_token_budget", """SELECT round(avg(t), 6) AS mean, max(t) AS max, quantile_cont(t, 0.5) AS q50, round(quantile_cont(t, 0.9), 6) AS q90, round(quantile_cont(t, 0.95), 6) AS q95, round(quantile_cont(t, 0.99), 6) AS q99 FROM (SELECT length(text) / 4.0::DOUBLE AS t FROM documents)""")
def txt_token_budget(spark, d):
    return rounded(T.token_budget(table(spark, d, "documents"), "text", [0.5, 0.9, 0.95, 0.99]), 6)
