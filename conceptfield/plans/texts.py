"""Text, thesaurus and evaluation queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation, texts, thesaurus
from .registry import query, table

#: The tables hold invented Latin-script prose, so the rules' word lists are given for it.
WORDS = {"the": "this", "der": "dieser", "et": "ainsi que", "la": "esta"}
PREFIXES = ("the ", "der ", "la ", "et ")
LATIN = {"letters": "a-zß-ÿ", "verb": r"(?i)\w+(?:ing|ed|er|en|tion)", "question_words": ("that", "que"), "openings": r"^the and\b|^die der\b", "dangling": "the and of a in der die und la el de et".split()}

MESSAGES_SQL = """msgs AS (SELECT user_id AS chat, event_type AS sender, epoch(ts) AS t, event_id AS id, props AS text FROM events),
    marked AS (SELECT *, CASE WHEN lag(sender) OVER (PARTITION BY chat ORDER BY t, id) = sender THEN 0 ELSE 1 END AS new FROM msgs),
    runs AS (SELECT *, sum(new) OVER (PARTITION BY chat ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM marked)"""


def messages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").alias("chat"), F.col("event_type").alias("sender"), t.alias("ts"), F.col("event_id").alias("id"), F.col("props").alias("text"))


@query(f"""WITH {MESSAGES_SQL} SELECT chat, sender, CAST(run AS BIGINT) AS run, count(*) AS n, min(id) AS first_id FROM runs GROUP BY chat, sender, run""")
def same_sender_runs(spark, sf_dir):
    return texts.same_sender_runs(messages(spark, sf_dir)).groupBy("chat", "sender", "run").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"""WITH RECURSIVE {MESSAGES_SQL},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY chat, run ORDER BY t, id) AS r FROM runs),
    walk AS (SELECT chat, run, sender, r, t AS anchor, r AS head, text FROM numbered WHERE r = 1
        UNION ALL SELECT n.chat, n.run, n.sender, n.r, CASE WHEN n.t - w.anchor < 86400 THEN w.anchor ELSE n.t END, CASE WHEN n.t - w.anchor < 86400 THEN w.head ELSE n.r END, n.text
        FROM walk w JOIN numbered n ON n.chat = w.chat AND n.run = w.run AND n.r = w.r + 1)
    SELECT * FROM (SELECT chat, sender, round(min(anchor), 3) AS ts, CAST(count(*) AS INTEGER) AS n, string_agg(text, chr(10) ORDER BY r) AS text FROM walk GROUP BY chat, sender, run, head) WHERE length(text) >= 9""")
def burst_merge(spark, sf_dir):
    return texts.burst_merge(messages(spark, sf_dir), 86400.0, 9).withColumn("ts", F.round("ts", 3))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM documents),
    m AS (SELECT *, CASE WHEN lag(c) OVER w = c THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
    g AS (SELECT doc_id, c, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM m),
    r AS (SELECT doc_id, g, min(p) AS p, CASE WHEN count(*) >= 3 AND min(c) <> chr(10) THEN min(c) ELSE repeat(min(c), count(*)) END AS s FROM g GROUP BY doc_id, g),
    a AS (SELECT doc_id, string_agg(s, '' ORDER BY p) AS s FROM r GROUP BY doc_id)
    SELECT doc_id, md5(coalesce(a.s, '')) AS collapsed FROM documents LEFT JOIN a USING (doc_id)""")
def text_repeat_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.collapse_repeats(F.coalesce("text", F.lit("")))).alias("collapsed"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squashed FROM documents""")
def whitespace_squash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.squash_space(F.col("text"))).alias("squashed"))


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS w, generate_subscripts(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1) AS p FROM documents),
    k AS (SELECT *, lower(regexp_replace(regexp_replace(w, '^[.,!?;:()«»"''—–…]+', ''), '[.,!?;:()«»"''—–…]+$', '')) AS core FROM w)
    SELECT doc_id, count(*) FILTER (WHERE core IN ('the', 'der', 'et', 'la')) AS hits, md5(string_agg(CASE core WHEN 'the' THEN replace(lower(w), 'the', 'this') WHEN 'der' THEN replace(lower(w), 'der', 'dieser') WHEN 'et' THEN replace(lower(w), 'et', 'ainsi que') WHEN 'la' THEN replace(lower(w), 'la', 'esta') ELSE w END, ' ' ORDER BY p)) AS translated
    FROM k GROUP BY doc_id""")
def slang_map(spark, sf_dir):
    words = F.split(X.squash_space(F.col("text")), " ")
    core = F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(X.EDGES))))
    hits = F.size(F.filter(core, lambda c: c.isin(*WORDS))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits"), F.md5(F.array_join(F.transform(words, lambda w: X.translate_word(w, WORDS)), " ")).alias("translated"))


@query("""SELECT page_id, 'so see ' || url || ' ok this end' AS normal FROM pages""")
def url_protect(spark, sf_dir):
    text = F.concat(F.lit("sooooo  see "), F.col("url"), F.lit(" okkkk the\tend"))
    return table(spark, sf_dir, "pages").select("page_id", X.normalise(text, {}, WORDS).alias("normal"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
    k AS (SELECT doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS segment, p FROM s)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS pos, md5(segment) AS segment FROM k WHERE segment <> ''""")
def segment_newline(spark, sf_dir):
    rows = texts.segment(table(spark, sf_dir, "documents").select("doc_id", "text"), X.newline_segments(F.col("text")))
    return rows.select("doc_id", "pos", F.md5("segment").alias("segment"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
    k AS (SELECT doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS segment, p FROM s),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM k WHERE segment <> ''),
    g AS (SELECT *, sum(CASE WHEN r > 1 AND (starts_with(lower(segment), 'the ') OR starts_with(lower(segment), 'der ') OR starts_with(lower(segment), 'la ') OR starts_with(lower(segment), 'et ')) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS g FROM f)
    SELECT doc_id, CAST(g - 1 AS INTEGER) AS pos, md5(string_agg(segment, ' ' ORDER BY r)) AS segment FROM g GROUP BY doc_id, g""")
def subordinate_remerge(spark, sf_dir):
    rows = texts.segment(table(spark, sf_dir, "documents").select("doc_id", "text"), X.remerge(X.newline_segments(F.col("text")), PREFIXES))
    return rows.select("doc_id", "pos", F.md5("segment").alias("segment"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!])[ \t\r\f]+', '\1' || chr(10), 'g'), chr(10))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!])[ \t\r\f]+', '\1' || chr(10), 'g'), chr(10)), 1) AS p FROM documents),
    a AS (SELECT doc_id, count(*) AS n, string_agg(trim(s), '|' ORDER BY p) AS joined FROM s WHERE trim(s) <> '' GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS sentences, md5(coalesce(joined, '')) AS joined FROM documents LEFT JOIN a USING (doc_id)""")
def sentence_split(spark, sf_dir):
    s = X.sentences(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("sentences"), F.md5(F.array_join(s, "|")).alias("joined"))


@query(r"""WITH s AS (SELECT doc_id, trim(text) AS s FROM documents),
    f AS (SELECT doc_id, s, lower(s) AS low, array_length(string_split(trim(regexp_replace(s, '\s+', ' ', 'g')), ' ')) AS n, length(regexp_replace(s, '[^a-zß-ÿ]', '', 'g')) AS own, length(regexp_replace(s, '[^a-zA-Zß-ÿ]', '', 'g')) AS letters,
        regexp_extract(regexp_replace(s, '[.!?,;: ]+$', ''), '(\S*)$', 1) AS last FROM s)
    SELECT doc_id, coalesce(own > 0 AND n BETWEEN 4 AND 200 AND 2 * own >= letters AND regexp_matches(s, '(?i)\w+(?:ing|ed|er|en|tion)') AND NOT regexp_matches(s, '^(https?://|www\.)\S+$')
        AND (NOT ends_with(s, '?') OR contains(low, 'that') OR contains(low, 'que') OR ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 5 = 0)
        AND NOT regexp_matches(low, '^the and\b|^die der\b') AND lower(last) NOT IN ('the', 'and', 'of', 'a', 'in', 'der', 'die', 'und', 'la', 'el', 'de', 'et') AND length(last) > 1, false) AS qualifies FROM f""")
def qualify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.qualifies(F.col("text"), F.col("doc_id"), None, LATIN, most=200).alias("qualifies"))


@query(r"""SELECT doc_id, CASE WHEN c = '' THEN 'simple_svo' ELSE c END AS categories FROM (SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}])(the|der|la)([^\p{L}]|$)') THEN 'article' END,
    CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}])(and|und|et|y)([^\p{L}]|$)') THEN 'coordination' END, CASE WHEN regexp_matches(text, '(?i)[a-z]ed([^\p{L}]|$)') THEN 'past' END, CASE WHEN regexp_matches(text, '!!') THEN 'exclaimed' END) AS c FROM documents)""")
def categorize(spark, sf_dir):
    classes = {"article": r"(^|[^\p{L}])(the|der|la)([^\p{L}]|$)", "coordination": r"(^|[^\p{L}])(and|und|et|y)([^\p{L}]|$)", "past": r"[a-z]ed([^\p{L}]|$)", "exclaimed": "!!"}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.categorise(F.col("text"), classes), ",").alias("categories"))


@query(r"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dedup_first(spark, sf_dir):
    key = F.sha2(F.lower(X.squash_space(F.col("text"))), 256)
    return texts.keep_first(table(spark, sf_dir, "documents").select("doc_id", "lang", key.alias("k")), F.col("k"), "doc_id").select("doc_id", "lang")


@query("""WITH c AS (SELECT doc_id, source, lang, md5(CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY source, lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS c FROM documents),
    g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN c > 3 THEN 1 ELSE 0 END, h, doc_id) AS pick FROM c)
    SELECT doc_id, source, lang, CAST(pick AS INTEGER) AS pick FROM g WHERE pick <= 20""")
def stratified_sample(spark, sf_dir):
    return texts.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "source", "lang", "doc_id", 3, 20)


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), t AS (SELECT DISTINCT substr(word, 2) AS word FROM w UNION SELECT DISTINCT word || 's' FROM w UNION SELECT word FROM w),
    d AS (SELECT t.word, min(w.word) AS fixed FROM t JOIN w ON levenshtein(t.word, w.word) <= 1 WHERE length(t.word) >= 5 AND t.word NOT IN (SELECT word FROM w) GROUP BY t.word)
    SELECT t.word, coalesce(d.fixed, t.word) AS fixed FROM t LEFT JOIN d ON d.word = t.word""")
def levenshtein_fix(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    typed = words.select(F.explode(F.array(F.col("word"), F.expr("substring(word, 2)"), F.concat("word", F.lit("s")))).alias("word"))
    return texts.spelling(typed, words)


def edges(spark, sf_dir):
    n, c, p = (table(spark, sf_dir, t) for t in ("nation", "customer", "part"))
    r = table(spark, sf_dir, "region")
    one = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.lit("PartOf").alias("rel"), F.lower("n_name").alias("start"), F.lower("r_name").alias("end"), F.lit(2.0).alias("weight"))
    two = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.lit("AtLocation").alias("rel"), F.lower("c_name").alias("start"), F.lower("n_name").alias("end"), (F.abs("c_acctbal") / 2000).alias("weight"))
    three = p.select(F.when(F.col("p_size") % 2 == 0, "IsA").otherwise("Antonym").alias("rel"), F.lower("p_name").alias("start"), F.lower("p_brand").alias("end"), (F.col("p_size") / 10.0).alias("weight"))
    return one.unionByName(two).unionByName(three)


EDGES_SQL = """edges AS (SELECT 'PartOf' AS rel, lower(n_name) AS s, lower(r_name) AS o, 2.0::DOUBLE AS weight FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'AtLocation', lower(c_name), lower(n_name), abs(c_acctbal) / 2000 FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT CASE WHEN p_size % 2 = 0 THEN 'IsA' ELSE 'Antonym' END, lower(p_name), lower(p_brand), p_size / 10.0::DOUBLE FROM part),
    rels(rel, verb, base, negative) AS (VALUES ('PartOf', 'входит_в', 0.7::DOUBLE, false), ('AtLocation', 'находится_в', 0.5::DOUBLE, false), ('IsA', 'является', 0.8::DOUBLE, false), ('Antonym', 'противоположен', 0.8::DOUBLE, true)),
    judged AS (SELECT s AS subject, verb, o AS object, CASE WHEN negative THEN 'NEGATIVE' ELSE 'AFFIRMATIVE' END AS quality, least(1.0, base * weight / 2) AS intensity FROM edges JOIN rels USING (rel) WHERE weight >= 1.0)"""


@query(f"WITH {EDGES_SQL} SELECT subject, verb, object, quality, round(intensity + 1e-9, 4) AS intensity FROM judged")
def edge_relation_map(spark, sf_dir):
    return thesaurus.edge_judgments(edges(spark, sf_dir)).select("subject", "verb", "object", "quality", F.round(F.col("intensity") + 1e-9, 4).alias("intensity"))


@query(f"WITH {EDGES_SQL}, t AS (SELECT lower(n_name) AS term FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'brand#7') SELECT verb, object, count(*) AS n FROM judged WHERE subject IN (SELECT term FROM t) OR object IN (SELECT term FROM t) GROUP BY verb, object")
def edge_term_semijoin(spark, sf_dir):
    terms = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.lower("n_name").alias("term")).unionByName(spark.createDataFrame([("brand#7",)], "term string"))
    return thesaurus.of_terms(thesaurus.edge_judgments(edges(spark, sf_dir)), terms).groupBy("verb", "object").agg(F.count("*").alias("n"))


@query("""SELECT p_brand AS synset, name AS lemma FROM (SELECT p_brand, name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_name END AS name FROM part) WHERE name NOT LIKE '% %') WHERE r = 1""")
def synset_first_lemma(spark, sf_dir):
    senses = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).otherwise(F.col("p_name")).alias("name"))
    return thesaurus.first_lemma(senses, "p_brand", "name", "p_partkey")


@query(f"WITH {EDGES_SQL} SELECT rel, count(*) AS n FROM edges GROUP BY rel")
def relation_counts(spark, sf_dir):
    return thesaurus.relation_counts(edges(spark, sf_dir))


@query("""SELECT n_nationkey, lower(n_name) || ' in' AS term, 'IsA' AS relation FROM nation""")
def uri_terms(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = n.select("n_nationkey", F.concat(F.lit("/c/ru/"), F.replace("n_name", F.lit("_"), F.lit("~")), F.lit("_in/n")).alias("u"))
    return rows.select("n_nationkey", F.replace(thesaurus.term(F.col("u")), F.lit("~"), F.lit("_")).alias("term"), thesaurus.relation(F.lit("/r/IsA")).alias("relation"))


TRIPLES_SQL = """gold AS (SELECT user_id * 100000 + event_id // 40 AS sent_id, event_id AS pos, event_type AS verb, 'k' || (props->>'k') AS object, CASE WHEN event_id % 7 = 0 THEN 'NEGATIVE' ELSE 'AFFIRMATIVE' END AS quality FROM events)"""


def triples(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sent = (F.col("user_id") * 100000 + F.floor(F.col("event_id") / 40)).alias("sent_id")
    return e.select(sent, F.col("event_id").alias("pos"), F.lit("someone").alias("subject"), F.col("event_type").alias("verb"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("object"), F.when(F.col("event_id") % 7 == 0, "NEGATIVE").otherwise("AFFIRMATIVE").alias("quality"))


@query(f"""WITH {TRIPLES_SQL}, sums AS (SELECT count(*) AS gold, count(*) FILTER (WHERE pos % 3 <> 0) AS extracted, count(*) FILTER (WHERE pos % 3 = 1) AS tp FROM gold)
    SELECT gold, extracted, tp, extracted - tp AS fp, gold - tp AS fn, round(tp / extracted::DOUBLE, 6) AS precision, round(tp / gold::DOUBLE, 6) AS recall, round(2.0 * tp / (gold + extracted), 6) AS f1 FROM sums""")
def extraction_eval(spark, sf_dir):
    gold = triples(spark, sf_dir)
    gold = gold.withColumn("verb", F.concat(F.lpad(F.col("pos").cast("string"), 12, "0"), F.lit("v"))).withColumn("object", F.reverse(F.lpad(F.col("pos").cast("string"), 12, "0")))
    found = gold.where("pos % 3 <> 0").withColumn("quality", F.when(F.col("pos") % 3 == 1, F.col("quality")).otherwise("WRONG"))
    out = evaluation.scores(evaluation.matched(found, gold.select(*found.columns)))
    return out.select(*[F.round(c, 6).alias(c) if c in ("precision", "recall", "f1") else c for c in out.columns])


#: Words of which some begin others: a match is a choice that later ones have to live with.
NESTED = ("ca", "cat", "cats", "catalog", "car", "care", "careful")
GREEDY_SQL = f"""w AS (SELECT event_id // 8 AS s, event_id AS pos, event_id % 2 = 0 AS gold, {list(NESTED)}[user_id % {len(NESTED)} + 1] AS object, event_id % 7 = 0 AS negative FROM events),
    g AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY pos) AS r FROM w WHERE gold), e AS (SELECT s, list({{'pos': pos, 'object': object, 'negative': negative}} ORDER BY pos) AS l FROM w WHERE NOT gold GROUP BY s),
    st AS (SELECT s, 0::BIGINT AS r, []::BIGINT[] AS used FROM (SELECT DISTINCT s FROM w) UNION ALL SELECT s, r, CASE WHEN len(fits) > 0 THEN list_append(used, fits[1]) ELSE used END
        FROM (SELECT st.s, g.r, used, [x.pos FOR x IN coalesce(e.l, []) IF NOT list_contains(used, x.pos) AND x.negative = g.negative AND (x.object = g.object OR starts_with(x.object, substr(g.object, 1, 4)) OR starts_with(g.object, substr(x.object, 1, 4)))] AS fits FROM st JOIN g ON g.s = st.s AND g.r = st.r + 1 LEFT JOIN e ON e.s = st.s))"""


@query(f"WITH RECURSIVE {GREEDY_SQL} SELECT w.s AS sent_id, count(*) FILTER (WHERE gold) AS gold, count(*) FILTER (WHERE NOT gold) AS extracted, (SELECT max(len(used)) FROM st WHERE st.s = w.s) AS tp FROM w GROUP BY w.s")
def greedy_matches(spark, sf_dir):
    """Matches of each sentence where several judgments compete for one another."""
    e = table(spark, sf_dir, "events")
    word = F.element_at(F.array(*map(F.lit, NESTED)), (F.col("user_id") % len(NESTED) + 1).cast("int"))
    rows = e.select(F.floor(F.col("event_id") / 8).alias("sent_id"), F.col("event_id").alias("pos"), F.lit("someone").alias("subject"), F.lit("be").alias("verb"), word.alias("object"), F.when(F.col("event_id") % 7 == 0, "NEGATIVE").otherwise("AFFIRMATIVE").alias("quality"))
    out = evaluation.matched(rows.where("pos % 2 = 1"), rows.where("pos % 2 = 0"))
    return out.select("sent_id", *[F.col(c).cast("long").alias(c) for c in ("gold", "extracted", "tp")])


@query(r"""WITH c AS (SELECT trim(regexp_replace(t, '\s+', ' ', 'g')) AS got, t, CASE WHEN conv_id % 2 = 0 THEN trim(regexp_replace(t, '\s+', ' ', 'g')) END AS want FROM (SELECT conv_id, regexp_replace(text, '(https?://\S+|www\.\S+)', '', 'g') AS t FROM conversations))
    SELECT count(*) FILTER (WHERE got = coalesce(want, t)) AS pass, count(*) FILTER (WHERE got <> coalesce(want, t) AND got = t) AS todo, count(*) FILTER (WHERE got <> coalesce(want, t) AND got <> t) AS fail, count(*) AS total FROM c""")
def calibration_eval(spark, sf_dir):
    bare = table(spark, sf_dir, "conversations").select("conv_id", F.regexp_replace("text", r"https?://\S+|www\.\S+", "").alias("original"))
    cases = bare.select("original", F.when(F.col("conv_id") % 2 == 0, X.squash_space(F.col("original"))).alias("expected"))
    return evaluation.calibration(cases, X.normalise(F.col("original"), {}, {}, repeats=False))


@query("""WITH t AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT conv_id, turn, role FROM t WHERE n <= 3 OR r = 1 OR r > n - 2""")
def trimmed_history(spark, sf_dir):
    from ..operators.feedback import trimmed_history as trim

    return trim(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 3, 2)
