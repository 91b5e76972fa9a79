"""Queries on tokens, lexicons, spelling and grammar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import words as W
from ..operators import grammar, lexicon, spell, tokens
from ..tables import cut, pieces
from .q_positions import D, docs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WORD = r"[\p{L}\p{M}\p{N}_]+"
#: Words with their numbers and offsets, and the lexicon: the words of benchmark in lower case.
TOK = f"""{D},
p AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w, regexp_split_to_array(text, '{WORD}') AS g FROM d),
u AS (SELECT doc_id, unnest(w) AS word, unnest(g[:len(w)]) AS gap, generate_subscripts(w, 1)::INT - 1 AS tok_idx FROM p WHERE len(w) > 0),
tok AS (SELECT doc_id, tok_idx, word, length(gap)::INT AS gap, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY tok_idx) - length(word))::INT AS start_off FROM u)"""
LEX = f"lex AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{WORD}'))) AS form FROM benchmark WHERE text IS NOT NULL)"
ORDINAL = "(regexp_matches(word, '^[0-9]*1[0-9]th$') OR regexp_matches(word, '^([0-9]*[02-9])?(1st|2nd|3rd|[04-9]th)$'))"
TAIL = "left(word, 1) || lower(substring(word, 2))"
UNKNOWN = f"""dist AS (SELECT DISTINCT word FROM tok WHERE NOT {ORDINAL}),
keys AS (SELECT word, unnest(CASE WHEN word = upper(word) THEN [word, lower(word), {TAIL}] WHEN left(word, 1) = upper(left(word, 1)) AND substring(word, 2) = lower(substring(word, 2)) THEN [word, lower(word)] ELSE [word] END) AS form FROM dist),
unk AS (SELECT word FROM dist WHERE word NOT IN (SELECT word FROM keys JOIN lex USING (form)))"""


def word_rows(spark, sf_dir):
    return tokens.word_table(docs(spark, sf_dir))


def placed_words(spark, sf_dir, least=1):
    return tokens.word_table(docs(spark, sf_dir), places=True, least=least)


def forms(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(F.explode(tokens.words(F.col("text"))).alias("w")).select(F.lower("w").alias("form")).distinct()


@query(f"WITH {TOK} SELECT doc_id, tok_idx, word, start_off FROM tok")
def tokens_(spark, sf_dir):
    return placed_words(spark, sf_dir).select("doc_id", "tok_idx", "word", "start_off")


QUERIES["tokens"], SQL["tokens"] = QUERIES.pop("tokens_"), SQL.pop("tokens_")


@query(f"WITH {TOK} SELECT doc_id, count(*)::BIGINT AS n_tokens, count(DISTINCT lower(word))::BIGINT AS n_distinct, sum(length(word))::BIGINT AS n_chars FROM tok GROUP BY doc_id")
def token_counts(spark, sf_dir):
    own = F.transform(tokens.words(F.col("text")), lambda w: F.lower(w))
    rows = docs(spark, sf_dir).select("doc_id", own.alias("w")).filter("size(w) > 0")
    chars = F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), chars.alias("n_chars"))


_GAP = r"\s\v\x{1C}-\x{1F}\x{85}\p{Z}"
_PICTURES = r"\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F000}-\x{1FAFF}"
_TOKEN_SQL = rf"[\p{{L}}\p{{M}}\p{{N}}_]+[{_PICTURES}]*|[{_PICTURES}]+|[^{_GAP}]"
_JOINED_SQL = rf"""[^{_GAP}()"'']+''(?:[\p{{L}}\p{{M}}\p{{N}}_]+[{_PICTURES}]*|[{_PICTURES}]+|[^{_GAP}()"''])|{_TOKEN_SQL}"""


@query(rf"""WITH {D}, e AS (SELECT doc_id, regexp_replace(text, '(\p{{L}}{{6,}}) ', '\1''s ', 'g') AS text FROM d), t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_JOINED_SQL}')) AS token FROM e)
SELECT doc_id, count(*)::BIGINT AS n_tokens, sum((token LIKE '%''s')::BIGINT)::BIGINT AS n_genitives, md5(string_agg(token, chr(10) ORDER BY token COLLATE "C")) AS tokens_md5 FROM t GROUP BY doc_id""")
def token_stage_merge(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"(\p{L}{6,}) ", "$1's "))
    rows = tokens.token_lists(d, ("doc_id",), "text").filter("size(tokens) > 0").repartition(pieces(d, 2 << 20), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    genitives = F.size(F.filter("tokens", lambda t: t.endswith("'s"))).cast("long")
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), genitives.alias("n_genitives"), F.md5(F.array_join(F.sort_array("tokens"), "\n")).alias("tokens_md5"))


_SPLIT_SQL = W.SPLIT_CHARS.replace("'", "''")


@query(f"""WITH {D}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]')) AS c FROM d)
SELECT doc_id, instr('{_SPLIT_SQL}', c) > 0 AS skipped, count(*)::BIGINT AS n FROM m GROUP BY ALL""")
def split_char_filter(spark, sf_dir):
    marks = docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\p{L}\p{M}\p{N}_\s]"), F.lit(0))).alias("c"))
    return marks.groupBy("doc_id", W.is_split_char(F.col("c")).alias("skipped")).agg(F.count("*").alias("n"))


RULES = [
    ("PFX", "A", True, "", "re", ""), ("PFX", "U", True, "", "un", ""), ("SFX", "D", True, "", "d", "e"), ("SFX", "D", True, "y", "ied", "[^aeiou]y"), ("SFX", "D", True, "", "ed", "[^ey]"),
    ("SFX", "G", True, "e", "ing", "e"), ("SFX", "G", True, "", "ing", "[^e]"), ("SFX", "S", False, "y", "ies", "[^aeiou]y"), ("SFX", "S", False, "", "s", "[^sxzhy]"),
]
_VALUES = ", ".join(f"('{k}', '{f}', {c}, '{s}', '{a}', '{x}')" for k, f, c, s, a, x in RULES)


@query(f"""WITH {LEX}, rules(kind, flag, crosses, strip, add, cond) AS (VALUES {_VALUES}),
stems AS (SELECT form AS stem, CASE length(form) % 4 WHEN 0 THEN 'AD' WHEN 1 THEN 'UGS' WHEN 2 THEN 'S' ELSE '' END AS flags FROM lex),
sfx AS (SELECT stem, substring(stem, 1, length(stem) - length(strip)) || add AS form, flags, crosses FROM stems JOIN rules ON kind = 'SFX' AND contains(flags, flag) AND regexp_matches(stem, cond || '$') AND suffix(stem, strip)),
base AS (SELECT stem, stem AS form, flags FROM stems UNION ALL SELECT stem, form, flags FROM sfx WHERE crosses),
pfx AS (SELECT stem, add || substring(form, length(strip) + 1) AS form FROM base JOIN rules ON kind = 'PFX' AND contains(flags, flag) AND regexp_matches(form, '^' || cond) AND starts_with(form, strip) AND (form = stem OR crosses))
SELECT stem, stem AS form FROM stems UNION SELECT stem, form FROM sfx UNION SELECT stem, form FROM pfx""")
def lexicon_expand(spark, sf_dir):
    n = F.char_length("form") % 4
    stems = forms(spark, sf_dir).select(F.col("form").alias("stem"), F.when(n == 0, "AD").when(n == 1, "UGS").when(n == 2, "S").otherwise("").alias("flags"))
    return lexicon.expand(stems, lexicon.affix_table(spark, RULES))


@query(f"""WITH {TOK}, {LEX}, {UNKNOWN}
SELECT doc_id, word, count(*)::BIGINT AS n, min(start_off)::INT AS first_off FROM tok WHERE word IN (SELECT word FROM unk) GROUP BY ALL""")
def misspelled(spark, sf_dir):
    rows = spell.misspelled(placed_words(spark, sf_dir), forms(spark, sf_dir))
    return rows.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("start_off").alias("first_off"))


def _per_doc(spark, sf_dir):
    return spell.misspelled(word_rows(spark, sf_dir).select("doc_id", "word"), forms(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_findings"))


@query(f"WITH {TOK}, {LEX}, {UNKNOWN} SELECT doc_id, count(*)::BIGINT AS n_findings FROM tok WHERE word IN (SELECT word FROM unk) GROUP BY ALL")
def misspelled_per_doc(spark, sf_dir):
    return _per_doc(spark, sf_dir)


@query(f"""WITH {TOK}, {LEX}, {UNKNOWN}, n AS (SELECT doc_id, count(*) AS n FROM tok WHERE word IN (SELECT word FROM unk) GROUP BY ALL)
SELECT lang, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_findings FROM n JOIN documents USING (doc_id) GROUP BY ALL""")
def misspelled_per_lang(spark, sf_dir):
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return _per_doc(spark, sf_dir).join(langs, "doc_id").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_findings").alias("n_findings"))


@query(f"""WITH {TOK}, {LEX}, {UNKNOWN}, f AS (SELECT * FROM tok WHERE word IN (SELECT word FROM unk))
SELECT count(*)::BIGINT AS n_findings, count(*) > 0 AS mistakes, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END::INT AS exit_code FROM f""")
def verdict(spark, sf_dir):
    from ..operators import findings

    return findings.verdict(spell.misspelled(word_rows(spark, sf_dir).select("doc_id", "word"), forms(spark, sf_dir)))


@query(f"""WITH {TOK}, {LEX}, {UNKNOWN}, f AS (SELECT count(*)::BIGINT AS n FROM tok WHERE word IN (SELECT word FROM unk))
SELECT detector, n AS n_findings, 0::BIGINT AS n_alone FROM f, (VALUES ('hunspell'), ('zspell'), ('spellbook')) v(detector)""")
def spell_agreement(spark, sf_dir):
    """Each detector looks words up by itself; the places that not all three flag are counted as alone.

    A detector looks at the word alone, so each gets the distinct words, with the number of their places.
    """
    from . import api

    rows, words = None, cut(word_rows(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n")), "words")
    for name in ("hunspell", "zspell", "spellbook"):
        own = api.flagged(words, forms(spark, sf_dir), name).select("word", "n", F.lit(name).alias("detector"))
        rows = own if rows is None else rows.union(own)
    agree = rows.groupBy("word", "n").agg(F.collect_list("detector").alias("ds"))
    agree = agree.select("n", F.explode("ds").alias("detector"), F.when(F.size("ds") < 3, F.col("n")).otherwise(0).alias("alone"))
    return agree.groupBy("detector").agg(F.sum("n").alias("n_findings"), F.sum("alone").alias("n_alone"))


@query(f"""WITH {TOK}, {LEX}, {UNKNOWN}, a AS (SELECT word FROM unk WHERE regexp_matches(word, '^[a-z]+$')), b AS (SELECT form FROM lex WHERE regexp_matches(form, '^[a-z]+$')),
n AS (SELECT word, form, levenshtein(word, form)::INT AS distance FROM a JOIN b ON abs(length(word) - length(form)) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, form)::INT AS rank FROM n WHERE distance BETWEEN 1 AND 2)
SELECT * FROM r""")
def suggest_levenshtein(spark, sf_dir):
    lex = forms(spark, sf_dir)
    bad = spell.unknown(word_rows(spark, sf_dir).select("word"), lex).filter(F.col("word").rlike("^[a-z]+$"))
    return spell.candidates(bad, lex.filter(F.col("form").rlike("^[a-z]+$"))).select("word", "form", F.col("distance").cast("int").alias("distance"), F.col("rank").cast("int").alias("rank"))


@query()
def suggest_every_word(spark, sf_dir):
    """Suggestions for all unknown words from all forms, in code points; suggest_levenshtein has those of a to z alone."""
    lex = forms(spark, sf_dir)
    near = spell.candidates(spell.unknown(word_rows(spark, sf_dir).select("word"), lex), lex)
    return near.select("word", "form", F.col("distance").cast("int").alias("distance"), F.col("rank").cast("int").alias("rank"))


PAIRS = [("th", "t"), ("t", "th"), ("e", "ee"), ("ee", "e"), ("s", "ss"), ("o", "oo"), ("in", "en"), ("a", "e"), ("ou", "o")]
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)


@query(f"""WITH {TOK}, {LEX}, {UNKNOWN}, pairs(src, dst) AS (VALUES {_PAIRS}),
h AS (SELECT word, src, dst, unnest(range(1, length(word) - length(src) + 2)) AS i FROM unk JOIN pairs ON contains(word, src)),
m AS (SELECT DISTINCT word, substring(word, 1, i - 1) || dst || substring(word, i + length(src)) AS form FROM h WHERE substring(word, i, length(src)) = src)
SELECT word, form FROM m WHERE form IN (SELECT form FROM lex)""")
def suggest_rep(spark, sf_dir):
    lex = forms(spark, sf_dir)
    bad = spell.unknown(word_rows(spark, sf_dir).select("word"), lex)
    return spell.replaced(bad, spark.createDataFrame(PAIRS, "src string, dst string"), lex)


@query(f"""WITH {LEX}, w AS (SELECT unnest([form, form || chr(188), chr(127808) || chr(127809), form || chr(127808), '12', '#', chr(8539)]) AS word FROM lex)
SELECT DISTINCT word, regexp_matches(word, '[\\x{{BC}}-\\x{{BE}}\\x{{2150}}-\\x{{215E}}\\x{{2189}}]') OR regexp_matches(word, '^[{W.EMOJI}]+$') AS ok FROM w""")
def quirk_emoji(spark, sf_dir):
    f = F.col("form")
    rows = forms(spark, sf_dir).select(F.explode(F.array(f, F.concat(f, F.lit("¼")), F.lit("🍀🍁"), F.concat(f, F.lit("🍀")), F.lit("12"), F.lit("#"), F.lit("⅛"))).alias("word")).distinct()
    return rows.select("word", W.is_emoji(F.col("word")).alias("ok"))


_DASH = f"""{LEX}, w AS (SELECT form, substring(form, 1, 2) || '-' || substring(form, 3) AS dashed FROM lex WHERE length(form) > 3)"""


@query(f"""WITH {_DASH} SELECT dashed AS word, true AS ok FROM w WHERE NOT contains(form, '-') UNION ALL SELECT dashed || 'x' AS word, false AS ok FROM w""")
def quirk_dashed(spark, sf_dir):
    rows = forms(spark, sf_dir).filter(F.char_length("form") > 3).withColumn("dashed", F.concat(F.substring("form", 1, 2), F.lit("-"), F.substring(F.col("form"), F.lit(3), F.char_length("form"))))
    rows = rows.select(F.explode(F.array("dashed", F.concat("dashed", F.lit("x")))).alias("word"), F.array("form").alias("replacements"))
    return rows.select("word", W.is_concatenation(F.col("word"), F.col("replacements")).alias("ok"))


@query(f"""WITH {_DASH} SELECT form AS word, true AS ok FROM w UNION ALL SELECT 'q' || form AS word, false AS ok FROM w""")
def quirk_dashless(spark, sf_dir):
    rows = forms(spark, sf_dir).filter(F.char_length("form") > 3).withColumn("dashed", F.concat(F.substring("form", 1, 2), F.lit("-"), F.substring(F.col("form"), F.lit(3), F.char_length("form"))))
    rows = rows.select(F.explode(F.array("form", F.concat(F.lit("q"), F.col("form")))).alias("word"), F.array("dashed").alias("replacements"))
    return rows.select("word", W.is_dashed_elsewhere(F.col("word"), F.col("replacements")).alias("ok"))


_RAW = f"{D}, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\s]+')) AS word FROM d)"


def _raw_words(spark, sf_dir):
    return docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("word")).distinct()


@query(f"WITH {_RAW} SELECT word FROM w WHERE NOT regexp_matches(word, '^[0-9]+[.,]?$') AND NOT regexp_matches(word, '@')")
def transform_whitelist(spark, sf_dir):
    return W.transformed(_raw_words(spark, sf_dir), ["^[0-9]+[.,]?$", "@"], {"atomic", "fragments"}).select("word")


@query(f"""WITH {_RAW} SELECT word, regexp_extract(word, '^(\\p{{L}}+)[-*&%$#!]+(\\p{{L}}*)', 1) AS first, regexp_extract(word, '^(\\p{{L}}+)[-*&%$#!]+(\\p{{L}}*)', 2) AS second
FROM w WHERE regexp_matches(word, '^(\\p{{L}}+)[-*&%$#!]+(\\p{{L}}*)')""")
def transform_fragments(spark, sf_dir):
    rows = _raw_words(spark, sf_dir)
    rows = W.transformed(rows, [r"^(\p{L}+)[-*&%$#!]+(\p{L}*)"], {"fragments"})
    piece = lambda k: F.coalesce(F.get("fragments", F.lit(k))["text"], F.lit(""))
    return rows.select("word", piece(0).alias("first"), piece(1).alias("second"))


_APART = [r"^([^@]+)@([^@]+)$", r"^(.+?)[.](.+)$", "^[0-9]+$", r"^(\p{L}+)[*&%$#!.,]+$"]
_NTH = " ".join(f"WHEN regexp_matches(part, '{p}') THEN {k}" for k, p in enumerate(_APART))
_FIRST = " ".join(f"WHEN {k} THEN regexp_extract(part, '{p}', 1)" for k, p in enumerate(_APART) if k != 2)
_SECOND = " ".join(f"WHEN {k} THEN regexp_extract(part, '{p}', 2)" for k, p in enumerate(_APART[:2]))


@query(f"""WITH RECURSIVE {_RAW}, t(word, pos, part, fit) AS (
  SELECT word, 0, word, CASE {_NTH.replace("part", "word")} END FROM w
  UNION ALL
  SELECT word, pos, part, CASE {_NTH} END FROM (
    SELECT word, pos + CASE WHEN x.second THEN length(CASE fit {_FIRST} END) + 1 ELSE 0 END AS pos, CASE WHEN x.second THEN CASE fit {_SECOND} END ELSE CASE fit {_FIRST} END END AS part
    FROM t, (VALUES (false), (true)) x(second) WHERE fit IS NOT NULL AND fit <> 2 AND (NOT x.second OR fit < 2)) n),
g AS (SELECT word, bool_or(coalesce(fit = 2, false)) AS listed, count(*) FILTER (WHERE fit IS NULL) AS n, coalesce(string_agg(part, ' ' ORDER BY pos) FILTER (WHERE fit IS NULL), '') AS fragments FROM t GROUP BY word)
SELECT word, CASE WHEN NOT listed AND n = 1 AND length(fragments) = length(word) THEN 'atomic' WHEN n > 0 THEN 'fragments' ELSE 'whitelisted' END AS outcome, fragments FROM g""")
def transform_recursive(spark, sf_dir):
    patterns = _APART
    rows = W.transformed(_raw_words(spark, sf_dir), patterns)
    return rows.select("word", "outcome", F.array_join(F.transform("fragments", lambda x: x["text"]), " ").alias("fragments"))


@query(f"""WITH {TOK}, l AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS b FROM tok) SELECT doc_id, tok_idx, word FROM l WHERE lower(word) = lower(b)""")
def grammar_doubled_word(spark, sf_dir):
    return grammar.doubled_words(docs(spark, sf_dir))


@query(f"""WITH {TOK}, l AS (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS next_word FROM tok),
v AS (SELECT *, regexp_matches(lower(next_word), '^[aeiou]') AS vowel FROM l WHERE next_word IS NOT NULL)
SELECT doc_id, tok_idx, word, next_word, CASE WHEN vowel THEN 'an' ELSE 'a' END AS replacement FROM v WHERE (lower(word) = 'a' AND vowel) OR (lower(word) = 'an' AND NOT vowel)""")
def grammar_a_an(spark, sf_dir):
    return grammar.a_or_an(docs(spark, sf_dir))


_MATCH = """SELECT doc_id, '{rule}' AS rule_id, unnest(regexp_extract_all(text, '{p}')) AS hit, unnest(regexp_split_to_array(text, '{p}')[:len(regexp_extract_all(text, '{p}'))]) AS gap,
generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS k FROM d WHERE regexp_matches(text, '{p}')"""
_ACTIVE = [(r[0], r[2]) for r in grammar.TEXT_RULES if r[1].lower() not in grammar.SKIPPED]


@query(f"""WITH {D}, m AS ({' UNION ALL '.join(_MATCH.format(rule=r, p=p) for r, p in _ACTIVE)}),
e AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rule_id ORDER BY k) AS stop FROM m)
SELECT doc_id, rule_id, (stop - length(hit))::INT AS start, stop::INT AS "end" FROM e""")
def grammar_spacing(spark, sf_dir):
    rows = grammar.matches(docs(spark, sf_dir), grammar.active(grammar.rule_table(spark, grammar.TEXT_RULES)))
    return rows.select("doc_id", "rule_id", "start", "end")


@query("SELECT rule_id, category FROM (VALUES " + ", ".join(f"('{r[0]}', '{r[1]}')" for r in grammar.TEXT_RULES) + ") v(rule_id, category) WHERE lower(category) NOT IN ('misspelling', 'typographical')")
def rule_category_filter(spark, sf_dir):
    return grammar.active(grammar.rule_table(spark, grammar.TEXT_RULES)).select("rule_id", "category")


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '12' WHEN 1 THEN 'word' WHEN 2 THEN '3' ELSE '+7' END AS head, CASE WHEN doc_id % 5 = 0 THEN '44' ELSE 'stem/AB' END AS body, CASE doc_id % 3 WHEN 0 THEN 'en_US' WHEN 1 THEN 'en-US' ELSE 'ende' END AS tag FROM documents)
SELECT doc_id, regexp_matches(head, '^\\+?[0-9]+$') AND NOT regexp_matches(body, '^[+-]?[0-9]+$') AS is_dictionary, regexp_matches(tag, '^[a-z]{2}_[A-Z]{2}$') AS is_language FROM f""")
def dictionary_validity(spark, sf_dir):
    k = F.col("doc_id")
    head = F.when(k % 4 == 0, "12").when(k % 4 == 1, "word").when(k % 4 == 2, "3").otherwise("+7")
    content = F.concat(head, F.lit("\n"), F.when(k % 5 == 0, "44").otherwise("stem/AB"), F.lit("\nother\n"))
    tag = F.when(k % 3 == 0, "en_US").when(k % 3 == 1, "en-US").otherwise("ende")
    return docs(spark, sf_dir).select("doc_id", W.is_dictionary(content).alias("is_dictionary"), W.is_language_tag(tag).alias("is_language"))
