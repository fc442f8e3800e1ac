"""The queries of the phonetics engine over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as X
from .functions import kernel, normalise, spelling
from .operators import compare, mining
from .plans import phonemes as P
from .sources import corpora
from .sources import lexicons as L
from .streaming import service

QUERIES: dict = {}
SQL: dict[str, str] = {}
VOWELLESS_MARKS = "aeiouáéíóúâêôãõàü"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pieces of SQL ----------------------------------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_replace(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {q(a)}, {q(b)})"
    return expr


def sql_decomposed(expr: str) -> str:
    return sql_replace(expr, X.COMPOSED.items())


def sql_plain_ipa(expr: str) -> str:
    s = sql_replace(sql_decomposed(f"translate(coalesce({expr}, ''), '‍‌', '')"), [("g", "ɡ")])
    return f"trim(regexp_replace(regexp_replace({s}, 'ˈ{{2,}}', 'ˈ', 'g'), '̃{{2,}}', '̃', 'g'), ' ')"


WORD_LIST = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_''-]+')"
EDGE = '[;:,.!?¡¿—…"«»“”(){}]'


def sql_ipa_words(expr: str) -> str:
    parts = f"string_split_regex(trim({expr}, ' '), '[ \\t\\n\\x0B\\f\\r]+')"
    return f"list_filter(list_transform({parts}, lambda w: regexp_replace(regexp_replace(w, '^{EDGE}+', ''), '{EDGE}+$', '')), lambda w: w <> '')"


def sql_bare(expr: str) -> str:
    return f"regexp_replace(regexp_replace(lower({expr}), '^[''-]+', ''), '[''-]+$', '')"


# written out here, so that the SQL doesn't repeat what the engine holds
ABBREVIATION_LIST = ", ".join(map(q, "sr sra srta dr dra prof profa eng av r pç ed apto ap pág pag fig obs ex etc cia ltda no tel cel kg km cm mm ml mg gb mb kb tb".split()))
SPELLED_OUT = ", ".join(map(q, normalise.ABBREVIATIONS))
NOT_SPEAKABLE = f"(regexp_matches({{0}}, '[^\\p{{{{L}}}}]') OR lower({{0}}) IN ({ABBREVIATION_LIST}))"


def sql_not_speakable(expr: str) -> str:
    return NOT_SPEAKABLE.format(expr)


# --- words and tokens -------------------------------------------------------------------------------------------


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.text_words(F.lower("text"))).alias("pos", "word"))


WORDS_CTE = f"words AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS word FROM (SELECT doc_id, {WORD_LIST.format('lower(text)')} AS l FROM documents))"


@query(f"WITH {WORDS_CTE} SELECT word, count(*) AS n FROM words GROUP BY word HAVING count(*) >= 2 ORDER BY n DESC, min((doc_id, pos)) LIMIT 50")
def frequent_words(spark, sf_dir):
    return mining.frequent_words(doc_words(spark, sf_dir))


TOKEN_SQL = "[\\p{L}\\p{M}''-]+|[;:,.!?—…\"«»“”(){}₹\\[\\]]|[ \\t\\n\\x0B\\f\\r]+"


@query(
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN_SQL}')) AS token FROM documents)
    SELECT doc_id, count(*) AS tokens, count(*) FILTER (regexp_matches(token, '\\p{{L}}')) AS words,
    count(*) FILTER (regexp_matches(token, '^[;:,.!?¡¿—…"«»“”(){{}}₹\\[\\]]+$')) AS marks FROM t GROUP BY doc_id"""
)
def tokens_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("sent"), F.col("text").alias("sentence"))
    rows = P.token_rows(docs).groupBy("doc").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("kind") == "word").alias("words"), F.count_if(F.col("kind") == "mark").alias("marks"))
    return rows.withColumnRenamed("doc", "doc_id")


@query(f"WITH {WORDS_CTE} SELECT DISTINCT word, regexp_matches(word, '[^\\p{{L}}]') OR lower(word) IN ({SPELLED_OUT}) OR (regexp_matches(word, '^\\p{{L}}{{2,6}}$') AND NOT regexp_matches(word, '[{VOWELLESS_MARKS}]')) AS odd FROM words")
def needs_normalising(spark, sf_dir):
    return doc_words(spark, sf_dir).select("word").distinct().select("word", X.needs_normalising(F.col("word")).alias("odd"))


@query(f"WITH {WORDS_CTE} SELECT word, count(*) AS n FROM words WHERE regexp_matches(word, '^\\p{{L}}{{2,6}}$') AND NOT regexp_matches(word, '[{VOWELLESS_MARKS}]') GROUP BY word")
def acronyms_no_vowel(spark, sf_dir):
    return doc_words(spark, sf_dir).where(X.vowelless(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


LETTER_MAP = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in spelling.LETTERS.items()) + "}"


@query(f"WITH {WORDS_CTE} SELECT DISTINCT word, array_to_string(list_transform(string_split(word, ''), lambda c: coalesce({LETTER_MAP}[lower(c)], c)), ' ') AS spelled FROM words WHERE length(word) <= 6")
def acronym_spelling(spark, sf_dir):
    return doc_words(spark, sf_dir).where(F.length("word") <= 6).select("word").distinct().select("word", X.acronym_words(F.col("word")).alias("spelled"))


_MARKED = r"regexp_replace(word, '([qg])u([eiéêí])', '\1ü\2', 'g')"
_SOUNDED = "agüentar cinqüenta consangüíneo eloqüente freqüência freqüente lingüiça lingüística qüinqüênio seqüência seqüestro tranqüilo".split()
_STEMS = "agüent|cinqüent|conseqüent|eloqüent|eqüent|freqüent|inqüil|liqüef|lingüiç|lingüíst|lingüet|bilíngüe|trilíngüe|qüestr|seqüestr|seqüen|tranqüil|eqüida|eqüidist|eqüilát|eqüitativ|igüidade|biqüida|tiqüíssim|verigüe|azigüe|pinqüe|ingüim|qüinqü|enxagüe|desagüe|sagüi"


@query(
    f"""WITH {WORDS_CTE} SELECT DISTINCT word, {_MARKED} <> word AND ({_MARKED} IN ({', '.join(map(q, _SOUNDED))}) OR regexp_matches({_MARKED}, '{_STEMS}')) AS sounded,
    NOT regexp_matches(strip_accents(word), '^({'|'.join(kernel.KS_NOT)})') AND regexp_matches(strip_accents(word), '{'|'.join(kernel.KS_STEMS)}') AS ks FROM words"""
)
def spelling_flags(spark, sf_dir):
    return doc_words(spark, sf_dir).select("word").distinct().select("word", X.sounded_u(F.col("word")).alias("sounded"), X.ks_stem(F.col("word")).alias("ks"))


# --- numbers ----------------------------------------------------------------------------------------------------


def _names(feminine: bool) -> str:
    ones, rest = spelling._ONES, spelling._TEENS
    ones = [*ones[:1], "uma", "duas", *ones[3:]] if feminine else ones
    arr = lambda xs: "[" + ", ".join(map(q, xs)) + "]"
    tens = arr(["", "", *spelling._TENS.values()])
    hundreds = [w[:-2] + "as" if feminine and i > 1 else w for i, w in spelling._HUNDREDS.items()]
    low = f"CASE WHEN n % 100 = 0 THEN NULL WHEN n % 100 < 10 THEN {arr(ones)}[n % 100 + 1] WHEN n % 100 < 20 THEN {arr(rest)}[n % 100 - 9] WHEN n % 10 = 0 THEN {tens}[n % 100 // 10 + 1] ELSE {tens}[n % 100 // 10 + 1] || ' e ' || {arr(ones)}[n % 10 + 1] END"
    return f"CASE WHEN n = 100 THEN 'cem' ELSE concat_ws(' e ', CASE WHEN n >= 100 THEN {arr(hundreds)}[n // 100] END, {low}) END"


def sql_integer(value: str, source: str, feminine: bool = False) -> str:
    """``v, said`` of the distinct non-negative integers under a billion."""
    return f"""low AS (SELECT n, {_names(feminine)} AS s FROM range(1000) t(n)), high AS (SELECT n, {_names(False)} AS s FROM range(1000) t(n)),
    v AS (SELECT DISTINCT CAST({value} AS BIGINT) AS v FROM {source}),
    p AS (SELECT v, v % 1000 AS g, (SELECT s FROM low WHERE n = v % 1000) AS a, v // 1000 % 1000 AS t, (SELECT s FROM low WHERE n = v // 1000 % 1000) AS b, v // 1000000 AS m, (SELECT s FROM high WHERE n = v // 1000000) AS c FROM v),
    h AS (SELECT *, concat_ws(' ', CASE WHEN m > 0 THEN c || CASE WHEN m = 1 THEN ' milhão' ELSE ' milhões' END END, CASE WHEN t = 1 THEN 'mil' WHEN t > 1 THEN b || ' mil' END) AS head FROM p),
    said AS (SELECT v, CASE WHEN v = 0 THEN 'zero' WHEN g = 0 THEN head WHEN head = '' THEN a WHEN g < 100 OR g % 100 = 0 THEN head || ' e ' || a ELSE head || ' ' || a END AS said FROM h)"""


@query(f"WITH {sql_integer('l_extendedprice * 100', 'lineitem')} SELECT v AS n, said AS words FROM said")
def number_words(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.round(F.col("l_extendedprice") * 100).cast("long").alias("n")).distinct()
    return rows.select("n", X.integer_words(F.col("n")).alias("words"))


@query(f"WITH {sql_integer('o_orderkey', 'orders', True)} SELECT v AS n, said AS words FROM said")
def number_words_feminine(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n")).distinct().select("n", X.integer_words(F.col("n"), True).alias("words"))


@query(f"WITH {sql_integer('year(o_orderdate)', 'orders')} SELECT v AS year, said AS words FROM said")
def year_words(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year")).distinct().select("year", X.year_words(F.col("year")).alias("words"))


_NTH = ["[" + ", ".join(map(q, t.values())) + "]" for t in spelling._NTH]


@query(f"SELECT DISTINCT p_size AS n, concat_ws(' ', CASE WHEN p_size >= 100 THEN {_NTH[2]}[p_size // 100] END, CASE WHEN p_size % 100 >= 10 THEN {_NTH[1]}[p_size % 100 // 10] END, CASE WHEN p_size % 10 > 0 THEN {_NTH[0]}[p_size % 10] END) AS words FROM part WHERE p_size BETWEEN 1 AND 999")
def ordinal_words(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size BETWEEN 1 AND 999").select(F.col("p_size").alias("n")).distinct().select("n", X.ordinal_words(F.col("n")).alias("words"))


_DIGITS = "[" + ", ".join(map(q, spelling._ONES)) + "]"


@query(f"SELECT o_orderkey, array_to_string(list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda c: {_DIGITS}[CAST(c AS INT) + 1]), ' ') AS words FROM orders")
def digit_words(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.digit_words(F.col("o_orderkey").cast("string")).alias("words"))


_CENTS = "CAST(round(l_discount * 100) AS BIGINT)"


@query(
    f"""WITH low AS (SELECT n, {_names(False)} AS s FROM range(1000) t(n)), d AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS w, lpad(CAST({_CENTS} AS VARCHAR), 2, '0') AS f FROM lineitem),
    k AS (SELECT w, f, rtrim(f, '0') AS kept, ltrim(rtrim(f, '0'), '0') AS rest FROM d),
    x AS (SELECT *, CASE WHEN w = 0 THEN 'zero' ELSE (SELECT s FROM low WHERE n = w) END AS whole, (SELECT s FROM low WHERE n = try_cast(rest AS BIGINT)) AS tail FROM k)
    SELECT w, f, CASE WHEN kept = '' THEN whole ELSE whole || ' vírgula ' || repeat('zero ', length(kept) - length(rest)) || tail END AS words FROM x"""
)
def decimal_words(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("w"), F.lpad(F.round(F.col("l_discount") * 100).cast("long").cast("string"), 2, "0").alias("f")).distinct()
    return rows.select("w", "f", X.decimal_words(F.col("w"), F.col("f")).alias("words"))


# --- normalisation ----------------------------------------------------------------------------------------------

_CHARS = "replace(translate(text, '‘’ʼ“”«»–—−\t\f\v ​', '''''''\"\"\"\"———     '), '…', '...')"


@query(f"SELECT doc_id, {_CHARS} AS text FROM documents")
def normalise_characters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.plain_characters(F.col("text")).alias("text"))


@query(f"SELECT doc_id, trim(regexp_replace({sql_replace('text', [(a, f' {b} ' if b else ' ') for a, b in normalise.SYMBOLS])}, ' {{2,}}', ' ', 'g'), ' ') AS text FROM documents")
def normalise_symbols(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.squeeze(X.symbol_words(F.col("text"))).alias("text"))


@query()
def normalise_full(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalised("text").alias("text"))


# written out here too: abbreviations that end no sentence
NO_BREAK_LIST = ", ".join(map(q, "sr sra srta dr dra prof profa eng exmo av r pç ed apto ap pág pag fig obs ex etc cia ltda núm no tel cel jan fev mar abr mai jun jul ago set out nov dez seg ter qua qui sex sáb dom vs p pp".split()))
_WHITE = "\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}"


def sql_sentences(key: str, source: str) -> str:
    """CTEs up to ``sentences`` (doc, sent, sentence): runs of text, marks and empty lines, cut after those that end a sentence."""
    word = f"lower(regexp_replace(regexp_extract(right(substr(t, 1, b - length(p)), 80), '[^{_WHITE}]*$'), '[^\\p{{L}}0-9]', '', 'g'))"
    return f"""whole AS (SELECT {key} AS doc, replace(text, chr(13) || chr(10), chr(10)) AS t FROM {source}),
    run AS (SELECT doc, t, unnest(range(len(l))) AS i, unnest(l) AS p FROM (SELECT doc, t, regexp_extract_all(t, '\\n\\n|[.!?…]+["'')\\]}}”»…]*|[^\\n.!?…]+|\\n') AS l FROM whole)),
    placed AS (SELECT *, CAST(sum(length(p)) OVER (PARTITION BY doc ORDER BY i) AS BIGINT) AS b FROM run),
    cut AS (SELECT doc, i, p, CASE WHEN p = chr(10) || chr(10) THEN 1 WHEN NOT regexp_matches(p, '^[.!?…]') THEN 0 WHEN b < length(t) AND NOT regexp_matches(substr(t, b + 1, 1), '[{_WHITE}]') THEN 0
    WHEN regexp_matches(substr(t, b + 1), '^[{_WHITE}]*[\\p{{Ll}}ªº0-9]') THEN 0 WHEN p[1] = '.' AND ({word} IN ({NO_BREAK_LIST}) OR regexp_matches({word}, '^\\p{{L}}$')) THEN 0 ELSE 1 END AS ends FROM placed),
    part_of AS (SELECT doc, i, p, coalesce(sum(ends) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM cut),
    joined AS (SELECT doc, g, regexp_replace(regexp_replace(string_agg(p, '' ORDER BY i), '^[{_WHITE}]+', ''), '[{_WHITE}]+$', '') AS sentence FROM part_of GROUP BY doc, g),
    sentences AS (SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY g) - 1 AS INTEGER) AS sent, sentence FROM joined WHERE sentence <> '')"""


@query(f"WITH {sql_sentences('doc_id', 'documents')} SELECT doc, sent, sentence FROM sentences")
def sentence_split(spark, sf_dir):
    return P.sentence_rows(table(spark, sf_dir, "documents"), normalise=False)


@query(f"WITH {sql_sentences('(conv_id, turn)', 'conversations')} SELECT doc[1] AS conv_id, count(*) AS sentences, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM sentences GROUP BY 1")
def sentence_stats(spark, sf_dir):
    rows = P.sentence_rows(table(spark, sf_dir, "conversations").withColumn("id", F.struct("conv_id", "turn")), "id", normalise=False)
    return rows.groupBy(F.col("doc.conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).alias("chars"))


# --- words to phonemes ------------------------------------------------------------------------------------------


@query()
def word_ipa(spark, sf_dir):
    return doc_words(spark, sf_dir).select("word").distinct().select("word", X.word_ipa("word").alias("ipa"))


@query()
def syllables(spark, sf_dir):
    return doc_words(spark, sf_dir).select("word").distinct().select("word", X.syllables("word").alias("syllables"))


def dictionaries(spark: SparkSession) -> P.Dictionaries:
    return P.Dictionaries(**L.seed(spark))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their context, a document being one sentence."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("sent"), F.col("text").alias("sentence"))
    return P.word_rows(docs, strict_compat=False)


_KIND = f"""CASE WHEN regexp_matches(token, '\\p{{L}}') THEN 'word' WHEN regexp_matches(token, '^[;:,.!?¡¿—…"«»“”(){{}}₹\\[\\]]+$') THEN 'mark' WHEN regexp_matches(token, '^[ \\t\\n\\x0B\\f\\r]+$') THEN 'space' ELSE 'other' END"""
_TOKEN_CTE = f"""tok AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN_SQL}') AS l FROM documents)),
kinds AS (SELECT *, {_KIND} AS kind FROM tok),
paused AS (SELECT *, count(*) FILTER (kind = 'mark') OVER (PARTITION BY doc_id ORDER BY pos) AS pause FROM kinds),
ahead AS (SELECT *, lead(token) OVER w AS nt, lead(pause) OVER w AS np, count(*) OVER (PARTITION BY doc_id) AS n_words FROM paused WHERE kind = 'word' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
told AS (SELECT doc_id, pos, token, n_words, CASE WHEN np = pause THEN nt[1] END AS initial FROM ahead)"""


@query(f"WITH {_TOKEN_CTE} SELECT doc_id, initial, count(*) AS n FROM told GROUP BY doc_id, initial")
def next_initial(spark, sf_dir):
    return _told(spark, sf_dir).groupBy(F.col("doc").alias("doc_id"), "initial").agg(F.count(F.lit(1)).alias("n"))


def _sql_last(expr: str, a: str, b: str) -> str:
    return f"regexp_replace({expr}, '{a}$', '{b}')"


_VOWEL = f"coalesce(regexp_matches(lower(initial), '^[{X.VOWELS}]'), false)"
_VOICED = f"coalesce(regexp_matches(lower(initial), '^[{X.VOWELS}{X.VOICED}]'), false)"


@query(
    f"""WITH {_TOKEN_CTE}, s AS (SELECT lower(token) AS word, initial, CASE WHEN {_VOICED} THEN {_sql_last('lower(token)', 's', 'z')} ELSE {_sql_last('lower(token)', 'z', 's')} END AS x FROM told),
    r AS (SELECT word, initial, CASE WHEN {_VOWEL} THEN {_sql_last('x', 'r', 'ɾ')} ELSE {_sql_last('x', 'ɾ', 'r')} END AS x FROM s),
    g AS (SELECT word, initial, CASE WHEN {_VOWEL} THEN {_sql_last(_sql_last('x', 'ʊ', 'w'), 'y', 'j')} ELSE {_sql_last(_sql_last('x', 'w', 'ʊ'), 'j', 'y')} END AS x FROM r)
    SELECT word, x AS said, count(*) AS n FROM g GROUP BY word, x"""
)
def sandhi(spark, sf_dir):
    rows = _told(spark, sf_dir).groupBy(F.lower("token").alias("word"), "initial").agg(F.count(F.lit(1)).alias("n"))
    said = X.sandhi_glide(X.sandhi_r(X.sandhi_s(F.col("word"), F.col("initial")), F.col("initial")), F.col("initial"))
    return rows.groupBy("word", said.alias("said")).agg(F.sum("n").alias("n"))


_SEED_CTE = "seed AS (SELECT * FROM (VALUES " + ", ".join(f"({q(layer)}, {q(w)}, {q(i)})" for layer, entries in L.SEED.items() for w, i in entries.items()) + ") t(layer, word, ipa))"


@query(
    f"""WITH {_TOKEN_CTE}, {_SEED_CTE},
    w AS (SELECT {sql_bare('token')} AS bare, n_words FROM told), p AS (SELECT n_words, unnest(list_filter(string_split(bare, '-'), lambda x: x <> '')) AS word FROM w),
    j AS (SELECT p.word, n_words > 1 AS context, cc.ipa AS c, cw.ipa AS d, sw.ipa AS e, sc.ipa AS f FROM p
    LEFT JOIN seed cc ON cc.layer = 'context_clitic' AND cc.word = p.word LEFT JOIN seed cw ON cw.layer = 'context_word' AND cw.word = p.word
    LEFT JOIN seed sw ON sw.layer = 'word' AND sw.word = p.word LEFT JOIN seed sc ON sc.layer = 'clitic' AND sc.word = p.word),
    r AS (SELECT word, CASE WHEN context AND c IS NOT NULL THEN 'context_clitic' WHEN context AND d IS NOT NULL THEN 'context_word' WHEN e IS NOT NULL THEN 'word' WHEN f IS NOT NULL THEN 'clitic' ELSE 'rules' END AS layer,
    CASE WHEN context THEN coalesce(c, d, e, f) ELSE coalesce(e, f) END AS base FROM j)
    SELECT word, layer, base, count(*) AS n FROM r GROUP BY word, layer, base"""
)
def lexicon_resolve(spark, sf_dir):
    # what answers a word depends on it and on whether it stands alone
    kinds = P.word_parts(_told(spark, sf_dir)).groupBy("word", F.least("n_words", F.lit(2)).alias("n_words")).agg(F.count(F.lit(1)).alias("n"))
    heard = P.spoken(kinds.withColumns({"part": F.lit(0), "initial": F.lit(None).cast("string")}), dictionaries(spark))
    return heard.groupBy("word", "layer", F.when(F.col("layer") != "rules", F.col("base")).alias("base")).agg(F.sum("n").alias("n"))


@query(
    """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), l AS (SELECT word, word AS ipa, 0 AS layer FROM w UNION ALL SELECT word, word || 'ˈ', 1 FROM w WHERE length(word) % 2 = 1
    UNION ALL SELECT word, 'ˈ' || word, 2 FROM w WHERE word < 'h') SELECT word, arg_max(ipa, layer) AS ipa FROM l GROUP BY word"""
)
def lexicon_layers(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    made = lambda ipa, kept: words.where(kept).select("word", ipa.alias("ipa"))
    word, stress = F.col("word"), F.lit("ˈ")
    return L.layered(made(word, F.lit(True)), made(F.concat(word, stress), F.length(word) % 2 == 1), made(F.concat(stress, word), word < "h"))


@query()
def phonemise(spark, sf_dir):
    return P.phonemise(table(spark, sf_dir, "documents"), dictionaries(spark))


@query()
def speech_chunks(spark, sf_dir):
    rows = P.speech(table(spark, sf_dir, "documents"), dictionaries(spark))
    return rows.select(F.col("doc").alias("doc_id"), "ipa", F.to_json("chunks").alias("chunks"))


@query()
def word_batch(spark, sf_dir):
    return P.word_map(doc_words(spark, sf_dir).select("word"), dictionaries(spark))


@query()
def service_batch(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    action = F.element_at(F.array(*map(F.lit, service.ACTIONS[2:5])), F.pmod("turn", F.lit(3)).cast("int") + 1)
    lines = turns.select(F.to_json(F.struct(action.alias("action"), "text")).alias("value"))
    return service.serve_batch(service.Service(spark, dictionaries(spark)), lines).select("response")


# --- phoneme strings --------------------------------------------------------------------------------------------

_MARK = "[.,!?:;…]"
_SPEECH_0 = f"regexp_replace(replace({sql_decomposed('''translate(text, '_' || chr(8205) || chr(8204), '')''')}, 'c', 'k'), '\\([^)]*(\\)|\\z)', '', 'g')"
_SPEECH = f"""s0 AS (SELECT doc_id, replace({_SPEECH_0}, chr(10), ' ') AS c FROM documents),
s1 AS (SELECT doc_id, CASE WHEN regexp_matches(c, '^{_MARK}') THEN substr(regexp_replace(c, '({_MARK})', ' \\1 ', 'g'), 2) ELSE regexp_replace(c, '({_MARK})', ' \\1 ', 'g') END AS c FROM s0),
speech AS (SELECT doc_id, regexp_replace(replace(c, '', ','), ' {{2,}}', ' ', 'g') AS ipa FROM s1)"""


@query(f"WITH {_SPEECH} SELECT doc_id, ipa FROM speech")
def speech_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.speech_text(F.col("text")).alias("ipa"))


@query(f"WITH {_SPEECH}, f AS (SELECT doc_id, unnest(regexp_extract_all(ipa, '[^,;:.!?…]*[,;:.!?…]|[^,;:.!?…]+')) AS p FROM speech), g AS (SELECT doc_id, trim(CASE WHEN regexp_matches(p, '[,;:.!?…]$') THEN p[:-2] ELSE p END, ' ') AS ipa, CASE WHEN regexp_matches(p, '[,;:.!?…]$') THEN p[-1] END AS punct FROM f) SELECT doc_id, punct, count(*) AS n, CAST(sum(length(ipa)) AS BIGINT) AS chars FROM g WHERE ipa <> '' GROUP BY doc_id, punct")
def pauses(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(X.pauses(X.speech_text(F.col("text")))))
    return rows.groupBy("doc_id", "punct").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("ipa")).alias("chars"))


@query(
    f"""WITH {_SPEECH}, w AS (SELECT doc_id, trim(ipa, ' ') AS ipa FROM speech),
    c AS (SELECT doc_id, ipa, list_filter(list_transform(regexp_extract_all(ipa, '[^.!?…]*[.!?…]|[^.!?…]+'), lambda p: trim(p, ' ')), lambda p: p <> '') AS l FROM w)
    SELECT doc_id, CASE WHEN length(ipa) <= 200 THEN ipa ELSE list_reduce(l, lambda a, p: CASE WHEN length(a) - coalesce(nullif(length(a) - instr(reverse(a), '') + 1, length(a) + 1), 0) + 1 + length(p) > 200 THEN a || '' || p ELSE a || ' ' || p END) END AS chunks FROM c WHERE ipa <> ''"""
)
def chunk_packing(spark, sf_dir):
    said = table(spark, sf_dir, "documents").select("doc_id", X.speech_text(F.col("text")).alias("said"))
    rows = said.where(F.trim("said") != "").select("doc_id", X.chunks(F.col("said")).alias("c"))  # such a text has a chunk
    return rows.select("doc_id", F.array_join("c", "\ue001").alias("chunks"))


# --- comparison: the second engine's output is the first one's with changes --------------------------------------

_CHANGES = [("th", "θ"), ("s ", "z "), (" a", " ˈa"), (" de ", " dʒy "), ("ing ", "ˌing "), ("ch ", "x "), ("qu", "k w"), ("our", "r")]


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.lower("text")
    for a, b in _CHANGES:
        other = F.replace(other, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sent_id"), F.col("text").alias("sentence"), F.lower("text").alias("ipa_a"), other.alias("ipa_b"))


_OUT = f"""outs AS (SELECT doc_id AS sent_id, text AS sentence, {sql_plain_ipa('lower(text)')} AS ipa_a, {sql_plain_ipa(sql_replace('lower(text)', _CHANGES))} AS ipa_b FROM documents),
lists AS (SELECT sent_id, {sql_ipa_words('ipa_a')} AS ta, {sql_ipa_words('ipa_b')} AS tb, {WORD_LIST.format('sentence')} AS tt FROM outs WHERE sentence IS NOT NULL),
al AS (SELECT sent_id, pos, coalesce(lower(tt[pos + 1]), '[' || pos || ']') AS word, ta[pos + 1] AS ipa_a, tb[pos + 1] AS ipa_b FROM (SELECT *, unnest(range(len(ta))) AS pos FROM lists WHERE len(ta) = len(tb))),
dif AS (SELECT * FROM al WHERE ipa_a <> ipa_b)"""


@query(f"WITH {_OUT} SELECT CAST(coalesce(sum(CASE WHEN len(ta) = len(tb) THEN len(ta) END), 0) AS BIGINT) AS total, CAST((SELECT count(*) FROM al WHERE ipa_a = ipa_b) AS BIGINT) AS matched, count(*) FILTER (len(ta) <> len(tb)) AS structural FROM lists")
def compare_aligned(spark, sf_dir):
    return compare.aligned_summary(outputs(spark, sf_dir))


@query(f"WITH {_OUT} SELECT sent_id, pos, word, ipa_a, ipa_b FROM dif")
def word_differences(spark, sf_dir):
    return compare.differences(outputs(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_OUT} SELECT count(*) AS total, count(*) FILTER (ipa_a = ipa_b) AS matched FROM outs WHERE sentence IS NOT NULL")
def compare_sentences(spark, sf_dir):
    return compare.compare_sentences(outputs(spark, sf_dir))


_STRIP = lambda c, marks: f"translate({c}, '{marks}', '')"
_HAMMING = "len(list_filter(list_zip(string_split(ipa_a, ''), string_split(ipa_b, '')), lambda x: x[1] <> x[2]))"
_CATEGORY = f"""CASE WHEN {_STRIP('ipa_a', 'ˌ')} = {_STRIP('ipa_b', 'ˌ')} THEN 'acento-secundario' WHEN {_STRIP('ipa_a', 'ˈ')} = {_STRIP('ipa_b', 'ˈ')} THEN 'acento-primario'
WHEN {_STRIP('ipa_a', 'ˈˌ')} = {_STRIP('ipa_b', 'ˈˌ')} THEN 'posicao-acento' WHEN length(ipa_a) = length(ipa_b) THEN CASE WHEN {_HAMMING} <= 3 THEN {_HAMMING} || '-char-diff' ELSE 'varios-chars-diff' END
WHEN abs(length(ipa_a) - length(ipa_b)) <= 3 THEN abs(length(ipa_a) - length(ipa_b)) || '-char-len' ELSE 'estrutural' END"""


@query(f"WITH {_OUT}, c AS (SELECT *, {_CATEGORY} AS category FROM dif), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sent_id, pos) AS r FROM c) SELECT category, count(*) AS n, string_agg(word, ',' ORDER BY r) FILTER (r <= 3) AS examples FROM r GROUP BY category")
def divergence_categories(spark, sf_dir):
    return compare.categories(outputs(spark, sf_dir))


@query(
    f"""WITH {_OUT}, e AS (SELECT sent_id, count(*) AS n FROM dif GROUP BY sent_id), p AS (SELECT coalesce(n, 0) AS n FROM documents d LEFT JOIN e ON e.sent_id = d.doc_id)
    SELECT CASE WHEN n >= 5 THEN '5+' ELSE CAST(n AS VARCHAR) END AS errors, count(*) AS sentences, count(*) * 100 / (SELECT count(*) FROM p) AS percent FROM p GROUP BY 1"""
)
def error_histogram(spark, sf_dir):
    return compare.errors_by_sentence(outputs(spark, sf_dir))


_TARGETS = ("the", "de", "est", "our", "sobre", "casa")


@query(
    f"""WITH {_OUT}, t AS (SELECT unnest([{', '.join(map(q, _TARGETS))}]) AS word), o AS (SELECT {sql_bare('w')} AS word, count(*) AS n FROM (SELECT unnest(tt) AS w FROM lists) GROUP BY 1), e AS (SELECT word, count(*) AS n FROM dif GROUP BY word)
    SELECT t.word, coalesce(o.n, 0) AS occurrences, coalesce(e.n, 0) AS errors, greatest(0, coalesce(o.n, 0) - coalesce(e.n, 0)) AS correct, CASE WHEN coalesce(o.n, 0) > 0 THEN greatest(0, o.n - coalesce(e.n, 0)) / o.n END AS accuracy
    FROM t LEFT JOIN o ON o.word = t.word LEFT JOIN e ON e.word = t.word"""
)
def homograph_accuracy(spark, sf_dir):
    return compare.homograph_accuracy(outputs(spark, sf_dir).where("sentence IS NOT NULL"), spark.createDataFrame([(w,) for w in _TARGETS], "word string"))


@query(f"WITH {_OUT} SELECT word, count(*) AS errors FROM dif GROUP BY word ORDER BY errors DESC, min((sent_id, pos)) LIMIT 15")
def worst_words(spark, sf_dir):
    return compare.worst_words(compare.differences(outputs(spark, sf_dir)))


def _lexicons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = doc_words(spark, sf_dir).select("word").distinct()
    left = words.select("word", F.when(F.length("word") != 5, F.col("word")).alias("ipa"))
    right = words.select("word", F.when(F.length("word") != 7, F.regexp_replace("word", "s$", "z")).alias("ipa"))
    return left, right


_LEX = f"{WORDS_CTE}, lx AS (SELECT word, CASE WHEN length(word) <> 5 THEN {sql_plain_ipa('word')} END AS a, CASE WHEN length(word) <> 7 THEN {sql_plain_ipa(_sql_last('word', 's', 'z'))} END AS b, CASE WHEN length(word) <> 7 THEN {_sql_last('word', 's', 'z')} END AS raw FROM (SELECT DISTINCT word FROM words))"


@query(f"WITH {_LEX} SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS total, count(*) FILTER (a = b) AS matched, count(*) FILTER (a IS NULL OR b IS NULL) AS skipped FROM lx")
def compare_words(spark, sf_dir):
    return compare.compare_words(*_lexicons(spark, sf_dir))[0]


@query(f"WITH {_LEX} SELECT word, raw AS ipa FROM lx WHERE raw IS NOT NULL AND coalesce(a, '') <> b")
def divergence_lexicon(spark, sf_dir):
    return compare.divergence_lexicon(*_lexicons(spark, sf_dir))


_PARTS = f"""tk AS (SELECT {sql_bare('t')} AS w FROM (SELECT unnest({WORD_LIST.format('text')}) AS t FROM documents)),
parts AS (SELECT word, {sql_not_speakable('word')} AS skipped FROM (SELECT unnest(CASE WHEN contains(w, '-') THEN list_filter(list_transform(string_split(w, '-'), lambda p: {sql_bare('p')}), lambda p: length(p) >= 2) ELSE [w] END) AS word FROM tk WHERE length(w) >= 2))"""


@query(f"WITH {_PARTS} SELECT DISTINCT word FROM parts WHERE NOT skipped")
def distinct_words(spark, sf_dir):
    return compare.distinct_words(table(spark, sf_dir, "documents"))


@query(f"WITH {_PARTS} SELECT count(*) FILTER (skipped) AS skipped FROM parts")
def skipped_words(spark, sf_dir):
    return compare.skipped_words(table(spark, sf_dir, "documents"))


_EXCEPT = ("lorem", "amet", "the")


@query(
    f"""WITH l AS (SELECT conv_id, turn, {WORD_LIST.format('text')} AS l FROM conversations)
    SELECT conv_id, turn FROM l WHERE NOT list_bool_or(list_transform(l, lambda t: length(t) >= 2 AND ({sql_not_speakable('t')} OR lower(t) IN ({', '.join(map(q, _EXCEPT))}))) || [false])"""
)
def plain_sentences(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return compare.plain_sentences(turns, spark.createDataFrame([(w,) for w in _EXCEPT], "word string")).select("conv_id", "turn")


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_cache(spark, sf_dir):
    return corpora.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT (SELECT count(DISTINCT doc_id) FROM labels) AS have, (SELECT count(DISTINCT doc_id) FROM documents) AS want")
def cache_coverage(spark, sf_dir):
    have = table(spark, sf_dir, "labels").agg(F.count_distinct("doc_id").alias("have"))
    return have.crossJoin(F.broadcast(table(spark, sf_dir, "documents").agg(F.count_distinct("doc_id").alias("want"))))  # one row each


_TEMPLATE_ROWS = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(compare.TEMPLATES))


@query(
    f"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), p AS (SELECT word, i, replace(t, '{{p}}', word) AS s FROM w, (VALUES {_TEMPLATE_ROWS}) v(i, t)),
    l AS (SELECT word, i, list_transform({WORD_LIST.format('s')}, lambda x: lower(x)) AS tt, {sql_ipa_words(sql_plain_ipa('lower(s)'))} AS ta, {sql_ipa_words(sql_plain_ipa(sql_replace('lower(s)', [(chr(32) + "á", "z á"), (chr(32) + "e", "z e")])))} AS tb FROM p),
    r AS (SELECT word, i, CASE WHEN len(tt) = len(ta) THEN ta[list_position(tt, lower(word))] END AS a, CASE WHEN len(tt) = len(tb) THEN tb[list_position(tt, lower(word))] END AS b FROM l)
    SELECT word, count(DISTINCT a) AS readings_a, count(DISTINCT b) AS readings_b, CASE WHEN count(DISTINCT a) = 1 AND count(DISTINCT b) = 1 THEN CASE WHEN min(a) = min(b) THEN 'consistent' ELSE 'systematic' END WHEN count(DISTINCT b) = 1 THEN 'excess' WHEN count(DISTINCT a) = 1 THEN 'missing rule' ELSE 'ambiguous' END AS verdict
    FROM r WHERE b IS NOT NULL GROUP BY word"""
)
def probe_matrix(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    rows = compare.probes(words)
    changed = F.replace(F.replace(F.lower("sentence"), F.lit(" á"), F.lit("z á")), F.lit(" e"), F.lit("z e"))
    read = lambda said: compare.reading_of(F.col("sentence"), said, F.col("word"))
    return compare.probe_verdicts(rows.select("word", "template", read(F.lower("sentence")).alias("ipa_a"), read(changed).alias("ipa_b")))


# --- mining -----------------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outputs(spark, sf_dir).where("sentence IS NOT NULL")
    plain = rows.select("sent_id", "sentence", X.plain_ipa(F.col("ipa_b")).alias("b"))
    lists = plain.select("sent_id", X.text_words(F.col("sentence")).alias("w"), X.ipa_words(F.col("b")).alias("s"))
    return lists.select("sent_id", mining.exact_pairs(F.col("w"), F.col("s")).alias("pairs"))


_BASE = lambda e: f"CASE WHEN {e} = '' THEN {e} ELSE left({e}, -1) || translate(right({e}, 1), 'zwjɾ', 'sʊyr') END"
_PAIR = f"{_OUT}, pr AS (SELECT sent_id, pos, {sql_bare('tt[pos + 1]')} AS word, tb[pos + 1] AS ipa, coalesce({sql_bare('tt[pos + 2]')}, '') AS follows FROM (SELECT *, unnest(range(len(tt))) AS pos FROM lists WHERE len(tt) = len(tb)))"


def _sql_modal(source: str, keys: str, value: str, seen: str) -> str:
    return f"mc AS (SELECT {keys}, {value} AS val, count(*) AS n, min({seen}) AS first FROM {source} GROUP BY {keys}, {value}), mr AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first) AS r, sum(n) OVER (PARTITION BY {keys}) AS total FROM mc), modal AS (SELECT {keys}, val, n, CAST(total AS BIGINT) AS total FROM mr WHERE r = 1)"


_ISOLATED = {"the": "the", "de": "dʒy", "it": "ɪt"}


@query(
    f"""WITH {_PAIR}, k AS (SELECT word AS key, ipa, sent_id, pos FROM pr WHERE word <> ''), {_sql_modal('k', 'key', 'ipa', '(sent_id, pos)')},
    iso AS (SELECT * FROM (VALUES {', '.join(f'({q(w)}, {_BASE(q(i))})' for w, i in _ISOLATED.items())}) t(key, alone))
    SELECT m.key, {_BASE('val')} AS ipa FROM modal m LEFT JOIN iso ON iso.key = m.key WHERE total >= 2 AND n / total >= 0.9 AND (alone IS NULL OR alone <> {_BASE('val')})"""
)
def context_lexicon(spark, sf_dir):
    return mining.context_lexicon(_pairs(spark, sf_dir), L.from_mapping(spark, _ISOLATED))


@query(f"WITH {_PAIR}, k AS (SELECT word || '|' || follows AS key, ipa, sent_id, pos FROM pr WHERE word <> ''), {_sql_modal('k', 'key', 'ipa', '(sent_id, pos)')} SELECT key, {_BASE('val')} AS ipa FROM modal WHERE total >= 2 AND n / total >= 0.9")
def context_lexicon_pairs(spark, sf_dir):
    return mining.context_lexicon(_pairs(spark, sf_dir), with_next=True)


@query(
    f"""WITH {_OUT}, nm AS (SELECT sent_id, tt, tb, len(tt) AS n, len(tb) AS m, list_sum(list_transform(tt, lambda w: length(w))) AS letters FROM lists WHERE len(tt) > 0 AND len(tb) > 0 AND abs(len(tt) - len(tb)) <= greatest(len(tt), len(tb)) // 2),
    ends AS (SELECT *, CASE WHEN m > n THEN list_reduce([[0::BIGINT]] || list_transform(range(n), lambda i: [length(tt[i + 1]), n - 1 - i]), lambda a, x: a || [greatest(a[-1] + 1, least(a[-1] + greatest(1, CAST(round_even(x[1] / letters * m, 0) AS BIGINT)), m - x[2]))])
    WHEN m < n THEN list_reduce([[0::BIGINT]] || list_transform(range(m), lambda i: [m - i]), lambda a, x: a || [CASE WHEN x[1] = 1 THEN n ELSE least(n, a[-1] + greatest(1, CAST(round_even((n - a[-1]) / x[1], 0) AS BIGINT))) END]) END AS e FROM nm),
    pair AS (SELECT sent_id, i, CASE WHEN m >= n THEN tt[i + 1] ELSE tt[e[i + 1] + 1] END AS word, CASE WHEN m > n THEN array_to_string(tb[e[i + 1] + 1:e[i + 2]], '') ELSE tb[i + 1] END AS ipa, m >= n OR e[i + 2] - e[i + 1] = 1 AS kept FROM (SELECT *, unnest(range(least(n, m))) AS i FROM ends))
    SELECT sent_id, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY i) - 1 AS INTEGER) AS pos, word, ipa FROM pair WHERE kept"""
)
def approximate_alignment(spark, sf_dir):
    return mining.approximate_pairs(outputs(spark, sf_dir))


_SENSES = {"the": "art", "de": "prep", "and": "conj"}


@query(
    f"""WITH {_OUT}, ex AS (SELECT * FROM (VALUES {', '.join(f'({q(w)}, {q(s)})' for w, s in _SENSES.items())}) t(word, sense)),
    s AS (SELECT DISTINCT sentence, ipa_b FROM outs WHERE sentence IS NOT NULL AND ipa_b <> ''), l AS (SELECT sentence, list_transform(regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x)) AS w, {sql_ipa_words('ipa_b')} AS t FROM s),
    o AS (SELECT ex.word, ex.sense || '-' || (length(sentence) % 2) AS sense, sentence, t[list_position(w, ex.word)] AS ipa FROM l, ex WHERE len(w) = len(t) AND list_position(w, ex.word) > 0), {_sql_modal('o', 'word, sense', 'ipa', 'sentence')}
    SELECT word, sense, {_BASE('val')} AS ipa, n / total AS confidence, total AS occurrences FROM modal WHERE total >= 2"""
)
def homograph_lexicon(spark, sf_dir):
    rows = outputs(spark, sf_dir).where("sentence IS NOT NULL").select("sentence", F.col("ipa_b").alias("ipa")).distinct()
    senses = spark.createDataFrame(list(_SENSES.items()), "word string, sense string")
    examples = rows.select("sentence").crossJoin(F.broadcast(senses)).select("word", F.concat_ws("-", "sense", (F.length("sentence") % 2).cast("string")).alias("sense"), "sentence")  # three rows
    return mining.homograph_lexicon(examples, rows)


@query(
    f"""WITH {_OUT}, bw AS (SELECT ipa_a, ipa_b, word, count(*) AS n, min((sent_id, pos)) AS first FROM dif GROUP BY ipa_a, ipa_b, word), tt AS (SELECT ipa_a, ipa_b, CAST(sum(n) AS BIGINT) AS total FROM bw GROUP BY ipa_a, ipa_b ORDER BY total DESC, min(first) LIMIT 40),
    r AS (SELECT bw.*, total, row_number() OVER (PARTITION BY bw.ipa_a, bw.ipa_b ORDER BY n DESC, first) AS r FROM bw JOIN tt ON tt.ipa_a = bw.ipa_a AND tt.ipa_b = bw.ipa_b WHERE total >= 2)
    SELECT ipa_a, ipa_b, total, string_agg(word || '(' || n || ')', ', ' ORDER BY r) AS words FROM r WHERE r <= 5 GROUP BY ALL"""
)
def divergence_pairs(spark, sf_dir):
    return mining.divergence_pairs(compare.differences(outputs(spark, sf_dir)), least=2)


@query(f"WITH {_OUT}, d AS (SELECT word, (ipa_a, ipa_b) AS pair, sent_id, pos FROM dif), {_sql_modal('d', 'word', 'pair', '(sent_id, pos)')} SELECT word, val[1] AS ipa_a, val[2] AS ipa_b, n, total FROM modal WHERE total >= 10")
def word_corrections(spark, sf_dir):
    return mining.word_corrections(compare.differences(outputs(spark, sf_dir)))


def items(spark: SparkSession, sf_dir: str, labels: DataFrame | None = None) -> DataFrame:
    """Every aligned occurrence with its context, as the miners take it; with ``labels`` (doc_id, trigger) those of labelled texts."""
    outs = outputs(spark, sf_dir).where("sentence IS NOT NULL")
    keep = [] if labels is None else ["trigger"]
    rows = compare.aligned(outs if labels is None else outs.join(labels, F.col("sent_id") == F.col("doc_id")), *keep, around=True)
    return rows.select(
        F.struct("sent_id", "pos").alias("id"), "word", "ipa_a", F.col("ipa_b").alias("ipa"), F.col("pos").alias("posicao"), "total", F.substring("proxima", 1, 1).alias("proxima_inicial"),
        F.substring(F.col("anterior"), -1, 1).alias("anterior_final"), (F.col("proxima").isNull()).alias("tem_pausa_depois"), F.col("proxima"), *keep,
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("ipa_a"), F.col("ipa")
    return mining.all_rules(mining.with_features(items(spark, sf_dir)), change=F.when(a == b, F.lit("igual")).otherwise(X.divergence(a, b)))


def _sql_letter(e: str) -> str:
    return f"CASE WHEN coalesce({e}, '') = '' THEN 'vazio' WHEN regexp_matches(lower({e}), '^[{mining.VOWELS}]') THEN 'vogal' WHEN regexp_matches(lower({e}), '^[bdgvzmnlr]') THEN 'sonora' WHEN regexp_matches(lower({e}), '^[ptkfsxʃ]') THEN 'surda' ELSE 'outra' END"


_ITEMS = f"""{_OUT}, ctx AS (SELECT *, lead(word) OVER w AS proxima, lag(word) OVER w AS anterior, count(*) OVER (PARTITION BY sent_id) AS total FROM al WINDOW w AS (PARTITION BY sent_id ORDER BY pos)),
items AS (SELECT (sent_id, pos) AS id, word, CASE WHEN ipa_a = ipa_b THEN 'igual' ELSE {_CATEGORY} END AS change, ipa_a, ipa_b AS ipa, pos AS posicao, total, proxima[1] AS proxima_inicial, anterior[-1] AS anterior_final, proxima IS NULL AS tem_pausa_depois, sent_id FROM ctx),
feat AS (SELECT id, sent_id, word, change, ipa, f.f, f.feature, f.value FROM items, LATERAL (VALUES (6, 'anterior_tipo', {_sql_letter('anterior_final')}), (7, 'proxima_tipo2', {_sql_letter('proxima_inicial')}),
(8, 'posicao_bucket', CASE WHEN total <= 1 THEN 'unico' WHEN posicao / (total - 1) < 0.2 THEN 'inicio' WHEN posicao / (total - 1) > 0.8 THEN 'fim' ELSE 'meio' END), (9, 'tamanho_bucket', CASE WHEN total <= 5 THEN 'curta' WHEN total <= 15 THEN 'media' ELSE 'longa' END),
{', '.join(f"({len(mining.CATEGORIES) + i}, {q(n)}, " + ("CASE WHEN tem_pausa_depois THEN 'sim' ELSE 'nao' END" if n == "tem_pausa_depois" else "'nao'") + ")" for i, n in enumerate(mining.FLAGS))}) f(f, feature, value))"""


def _sql_rules(scope: str, keys: str, tag: str) -> str:
    few = "" if scope == "global" else "HAVING sum(n) >= 5"
    word = "''" if scope == "global" else "word"
    return f"""b{tag} AS (SELECT {keys}, max(n) / sum(n) AS baseline FROM (SELECT {keys}, ipa, count(*) AS n FROM items GROUP BY {keys}, ipa) GROUP BY {keys} {few}),
    c{tag} AS (SELECT {keys}, f, feature, value, ipa, count(*) AS n, min(id) AS first FROM feat GROUP BY {keys}, f, feature, value, ipa),
    m{tag} AS (SELECT {keys}, f, feature, value, arg_min(ipa, (-n, first)) AS ipa, max(n) AS n, CAST(sum(n) AS BIGINT) AS coverage FROM c{tag} GROUP BY {keys}, f, feature, value),
    r{tag} AS (SELECT '{scope}' AS scope, change, {word} AS word, f, feature, value, ipa, coverage, n / coverage AS precision, n / coverage - baseline AS gain, baseline FROM m{tag} JOIN b{tag} USING ({keys}) WHERE coverage >= 5 AND n / coverage >= 0.85 AND n / coverage > baseline + 0.02)"""


_RULES = f"{_ITEMS}, {_sql_rules('global', 'change', 'g')}, {_sql_rules('palavra', 'word, change', 'w')}, rules AS (SELECT * FROM rg UNION ALL SELECT * FROM rw)"
_ROUND = "round(precision, 9) AS precision, round(gain, 9) AS gain, round(baseline, 9) AS baseline"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query(f"WITH {_RULES} SELECT scope, change, word, feature, value, ipa, coverage, {_ROUND} FROM rules")
def rule_mining(spark, sf_dir):
    return rounded(rules(spark, sf_dir).select("scope", "change", "word", "feature", "value", "ipa", "coverage", "precision", "gain", "baseline"), "precision", "gain", "baseline")


@query(f"WITH {_RULES} SELECT change, feature, value, ipa, CAST(sum(coverage) AS BIGINT) AS coverage, round(arg_max(precision, (f, coverage, precision)), 9) AS precision, round(arg_max(gain, (f, coverage, precision)), 9) AS gain, round(arg_max(baseline, (f, coverage, precision)), 9) AS baseline FROM rules WHERE scope = 'global' GROUP BY change, feature, value, ipa")
def rules_consolidated(spark, sf_dir):
    return rounded(mining.consolidated(rules(spark, sf_dir)), "precision", "gain", "baseline")


@query(f"WITH {_RULES} SELECT scope, change, word, feature, value, ipa, coverage, round(coverage * gain * ln(precision + 1), 6) AS score, coverage >= 10 AND precision >= 0.9 AS implementable FROM rules ORDER BY coverage * gain * ln(precision + 1) DESC, scope, change, word, feature, value, ipa LIMIT 30")
def rules_ranked(spark, sf_dir):
    ranked = mining.ranked_rules(rules(spark, sf_dir))
    return ranked.select("scope", "change", "word", "feature", "value", "ipa", "coverage", F.round("score", 6).alias("score"), "implementable")


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("trigger"))


@query(
    f"""WITH {_ITEMS}, j AS (SELECT 'q' || l.quality AS trigger, feature || '=' || value AS feature_value, count(*) AS n FROM feat f JOIN labels l ON l.doc_id = f.sent_id WHERE l.quality IS NOT NULL AND feature IN ({', '.join(map(q, mining.LABELLED))}) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY trigger ORDER BY n DESC, feature_value) AS r FROM j) SELECT trigger, feature_value, n FROM r WHERE r <= 5"""
)
def label_cooccurrence(spark, sf_dir):
    return mining.label_cooccurrence(mining.with_features(items(spark, sf_dir, triggers(spark, sf_dir))))


@query(
    """WITH e AS (SELECT coalesce(event_type, '') || '|' || user_id || '|' || '' || '|' || '' || '|' || '' || '|' || 'false' AS k, event_id, value, props FROM events), l AS (SELECT k, arg_max(props, event_id) AS trigger FROM e WHERE value >= 50 GROUP BY k)
    SELECT event_id, trigger FROM e LEFT JOIN l ON l.k = e.k"""
)
def label_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("event_type").alias("palavra"), F.col("user_id").alias("ipa_rs"), *[F.lit(None).cast("string").alias(c) for c in ("ipa_espeak", "proxima", "posicao_rel")], F.lit(False).alias("tem_pausa_depois"), "event_id", "value", "props")
    labels = rows.where("value >= 50").select(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in mining.LABEL_KEY]).alias("_key"), F.col("props").alias("trigger"), F.col("event_id").alias("seq"))
    return mining.with_labels(rows, labels).select("event_id", "trigger")


@query(
    f"""WITH {_ITEMS}, w AS (SELECT word, count(*) AS n, count(DISTINCT ipa_a) = 1 AS a, count(DISTINCT ipa) = 1 AS b FROM items GROUP BY word),
    v AS (SELECT id, word, ipa, f.f, f.feature, f.value FROM items, LATERAL (VALUES (1, 'proxima_inicial', proxima_inicial), (3, 'anterior_final', anterior_final), (5, 'tem_pausa_depois', CAST(tem_pausa_depois AS VARCHAR))) f(f, feature, value) WHERE f.value IS NOT NULL),
    c AS (SELECT word, f, feature, value, ipa, count(*) AS n, min(id) AS first FROM v GROUP BY ALL), m AS (SELECT word, f, feature, value, arg_min(ipa, (-n, first)) AS top, max(n) AS n, sum(n) AS total FROM c GROUP BY word, f, feature, value),
    s AS (SELECT word, f, feature, sum(n) / sum(total) * ln(count(*) + 1) AS score FROM m GROUP BY word, f, feature HAVING count(DISTINCT top) > 1),
    best AS (SELECT word, arg_min((feature, score), (-round(score, 9), f)) AS b FROM s GROUP BY word)
    SELECT w.word, w.n, CASE WHEN w.a AND w.b THEN 'lexical' WHEN NOT w.a AND NOT w.b THEN 'ambiguo' WHEN w.a THEN 'regra' ELSE 'inverso' END AS verdict, best.b[1] AS best_feature, round(best.b[2], 9) AS score FROM w LEFT JOIN best ON best.word = w.word"""
)
def word_variation(spark, sf_dir):
    return rounded(mining.variation(items(spark, sf_dir)), "score")


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return speech_chunks(spark, sf_dir)
