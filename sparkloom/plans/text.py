"""Cleaning, tokens, vocabularies, TF-IDF, summaries, suggestion (X, J04-J11, W07-W09, A11-A12, T05-T08, U04, M13)."""

from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.functions.stem import (DOUBLE, ENDS_CONSONANT, ENDS_CVC, HAS_VOWEL, IRREGULAR, M_EQ_1, M_GT_0, M_GT_1,
                                      STEP_2, STEP_3, STEP_4)
from sparkloom.operators import text as ops
from sparkloom.plans.registry import query, rnd, rnd_sql, table
from sparkloom.runtime import cut_lineage, spread

SP = r"\t-\r\x1c-\x20\x{85}\p{Z}"
PUNCT_SQL = tx.PUNCTUATION.replace("'", "''")
WORD = r"'[^\p{L}\p{N}_]+'"
STOPS = ["the", "and", "of", "to", "in", "is", "le", "la", "et", "der", "die", "und", "el", "de", "que"]
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOPS) + "]"


def sql_words(col, least=1):
    return f"list_filter(regexp_split_to_array(lower({col}), {WORD}), lambda t: len(t) >= {least})"


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def doc_tokens(spark, sf, min_chars=1):
    return docs(spark, sf).select("doc_id", tx.words("text", min_chars).alias("tokens"))


def conv_tokens(spark, sf):
    conv = spread(table(spark, sf, "conversations"), "conv_id", "turn")
    return conv.select("conv_id", "turn", tx.words("text").alias("tokens"))


TOK = f"(select doc_id, unnest({sql_words('text')}) as word from documents)"
TOKPOS = f"""(select doc_id, words[p] as word, p - 1 as pos from
  (select doc_id, words, unnest(range(1, len(words) + 1)) as p from (select doc_id, {sql_words('text')} as words from documents)))"""
CONV = f"(select conv_id, turn, {sql_words('text')} as tokens from conversations)"


# ---- cleaning ---------------------------------------------------------------

def cleaner(name, source, key, col, spark_fn, sql_expr):
    @query(name, f"select {key}, {sql_expr} as out from {source}")
    def run(spark, sf):
        return spread(table(spark, sf, source).select(key, col), key).select(key, spark_fn(F.col(col)).alias("out"))
    return run


cleaner("X01_to_lower", "documents", "doc_id", "text", tx.to_lower, "lower(text)")
cleaner("X02_strip_html", "pages", "page_id", "html", tx.strip_html, "regexp_replace(html, '<.*?>', '', 'g')")
cleaner("X03_strip_urls", "documents", "doc_id", "text", tx.strip_urls,
        f"regexp_replace(text, 'https?://[^{SP}]+|www\\.[^{SP}]+', '', 'g')")
cleaner("X03_strip_urls_pages", "pages", "page_id", "html", tx.strip_urls,
        f"regexp_replace(html, 'https?://[^{SP}]+|www\\.[^{SP}]+', '', 'g')")
cleaner("X04_strip_punct", "documents", "doc_id", "text", tx.strip_punct, f"translate(text, '{PUNCT_SQL}', '')")
cleaner("X05_strip_emoji", "documents", "doc_id", "text", tx.strip_emoji, f"regexp_replace(text, '{tx.EMOJI}', '', 'g')")
cleaner("X06_content_words", "documents", "doc_id", "text", lambda c: tx.content_words(F.lower(c), STOPS),
        f"""list_aggregate(list_filter(regexp_split_to_array(lower(text), {WORD}),
  lambda t: regexp_matches(t, '^\\p{{L}}+$') and not list_contains({STOP_SQL}, t)), 'string_agg', ' ')""")
cleaner("X10_space_punct", "documents", "doc_id", "text", tx.space_punct,
        r"regexp_replace(regexp_replace(text, '([.,!?])', ' \1 ', 'g'), '[^a-zA-Z.,!?]+', ' ', 'g')")
cleaner("X11_normalize_string", "documents", "doc_id", "text", tx.normalize_string,
        r"trim(regexp_replace(regexp_replace(regexp_replace(text, '([.!?])', ' \1', 'g'), '[^a-zA-Z.!?]+', ' ', 'g'), '\s+', ' ', 'g'))")
cleaner("X12_word_split", "documents", "doc_id", "text", tx.word_split,
        f"array_to_string(regexp_split_to_array(text, {WORD}), ' ')")
cleaner("X12_word_split_alpha", "documents", "doc_id", "text", lambda c: tx.word_split(c, alpha_only=True),
        f"array_to_string(list_filter({sql_words('text')}, lambda t: regexp_matches(t, '^\\p{{L}}+$')), ' ')")
cleaner("X13_squeeze_spaces", "documents", "doc_id", "text", tx.squeeze_spaces,
        f"trim(regexp_replace(text, '[{SP}]+', ' ', 'g'))")
cleaner("X14_drop_chars", "documents", "doc_id", "text", tx.drop_chars, "translate(text, '!@#$%^&*()''', '')")


@query("X15_split_sentences", f"""
select doc_id, pos::int as pos, s[pos + 1] as sentence, n::int as words from (
  select doc_id, s, unnest(range(len(s))) as pos from (
    select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[{SP}]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as s
    from documents)) , lateral (select len({sql_words('s[pos + 1]')}) as n)""")
def x15(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(tx.split_sentences("text")).alias("pos", "sentence")) \
        .withColumn("words", F.size(tx.words("sentence")))


# ---- stems and lemmas -------------------------------------------------------

def _stem_sql() -> str:
    def q(s):
        return s.replace("(?:", "(").replace("'", "''")

    def cut(n, v="w"):
        return f"left({v}, len({v}) - {n})"

    def has(x, shape):
        return f"regexp_matches({x}, '{q(shape)}')"

    def rules(items, v="w"):
        return "".join(f" when ends_with({v}, '{s}') then case when {has(cut(len(s), v), shape) if shape else 'true'} "
                       f"then {cut(len(s), v)} || '{r}' else {v} end" for s, r, shape in items)

    two = [(s, r, M_GT_0) for s, r in STEP_2]
    steps = [
        f"case when ends_with(w, 'ies') and len(w) = 4 then {cut(1)}" + rules([("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", "")]) + " else w end",
        f"case when ends_with(w, 'ied') then {cut(3)} || case when len(w) = 4 then 'ie' else 'i' end "
        f"when ends_with(w, 'eed') then case when {has(cut(3), M_GT_0)} then {cut(1)} else w end "
        f"when ends_with(w, 'ed') and {has(cut(2), HAS_VOWEL)} then '*' || {cut(2)} when ends_with(w, 'ed') then w "
        f"when ends_with(w, 'ing') and {has(cut(3), HAS_VOWEL)} then '*' || {cut(3)} else w end",
        f"case when not starts_with(w, '*') then w when regexp_matches(b, '(at|bl|iz)$') then b || 'e' "
        f"when regexp_matches(b, '{q(DOUBLE)}') then left(b, len(b) - 1) "
        f"when {has('b', M_EQ_1)} and {has('b', ENDS_CVC)} then b || 'e' else b end",
        f"case when ends_with(w, 'y') and len(w) > 2 and {has(cut(1), ENDS_CONSONANT)} then {cut(1)} || 'i' else w end",
        f"case when ends_with(w, 'alli') and {has(cut(4), M_GT_0)} then {cut(2)} || '*' "
        f"when ends_with(w, 'logi') then case when {has(cut(3), M_GT_0)} then {cut(1)} else w end {rules(two)} else w end",
        f"case when not ends_with(w, '*') then w {rules(two, 'c')} else c end",
        "case" + rules([(s, r, M_GT_0) for s, r in STEP_3]) + " else w end",
        "case" + "".join(f" when ends_with(w, '{s}') then case when {has(cut(len(s)), M_GT_1)}"
                         + (f" and {has(cut(3), '[st]$')}" if s == "ion" else "") + f" then {cut(len(s))} else w end"
                         for s in STEP_4) + " else w end",
        f"case when ends_with(w, 'e') and ({has(cut(1), M_GT_1)} or ({has(cut(1), M_EQ_1)} and not {has(cut(1), ENDS_CVC)})) then {cut(1)} else w end",
        f"case when ends_with(w, 'll') and {has(cut(1), M_GT_1)} then {cut(1)} else w end",
    ]
    inner = f"select distinct word, word as w from {TOK}"
    for s in steps:
        inner = f"select word, {s} as w from (select word, w, w[2:] as b, left(w, len(w) - 1) as c from ({inner}))"
    pool = " ".join(f"when '{k}' then '{v}'" for k, v in IRREGULAR.items())
    return f"select word, case word {pool} else case when len(word) <= 2 then word else w end end as stem from ({inner})"


@query("X07_stem_vocab", _stem_sql())
def x07(spark, sf):
    return ops.stem_vocab(doc_tokens(spark, sf), "tokens").withColumnRenamed("base", "stem")


@query("X07_stem_documents", f"""with stems as ({_stem_sql()})
select doc_id, coalesce(stems, '') as stems from documents left join (
  select doc_id, string_agg(stem, ' ' order by pos) as stems from {TOKPOS} t join stems using (word) group by doc_id) using (doc_id)""")
def x07b(spark, sf):
    tokens = doc_tokens(spark, sf)
    return ops.stem(tokens, ["doc_id"], "tokens").select("doc_id", F.array_join("tokens", " ").alias("stems"))


LEMMAS = f"""lemmas as (select word as form, left(word, len(word) - 1) as lemma from (select distinct word from {TOK}) v
  where ends_with(word, 's') and len(word) > 3 and left(word, len(word) - 1) in (select word from {TOK}))"""


def lemma_table(tokens):
    """Plural forms whose singular occurs in the same corpus, as (form, pos, lemma)."""
    seen = tokens.select(F.explode("tokens").alias("form")).distinct()
    plural = seen.filter(F.endswith("form", F.lit("s")) & (F.length("form") > 3)) \
        .withColumn("lemma", F.substring("form", F.lit(1), F.length("form") - 1))
    return plural.join(seen.select(F.col("form").alias("lemma")), "lemma", "left_semi") \
        .select("form", F.lit("n").alias("pos"), "lemma")


@query("X08_lemmatize", f"""
with {LEMMAS} select doc_id, coalesce(lemmas, '') as lemmas from documents left join (
  select doc_id, string_agg(coalesce(lemma, word), ' ' order by pos) as lemmas
  from {TOKPOS} t left join lemmas on word = form group by doc_id) using (doc_id)""")
def x08(spark, sf):
    tokens = doc_tokens(spark, sf)
    lemmas = cut_lineage(lemma_table(tokens))
    out = ops.lemmatize(tokens, ["doc_id"], "tokens", lemmas)
    return out.select("doc_id", F.array_join("tokens", " ").alias("lemmas"))


CLEAN = (f"regexp_replace(translate(regexp_replace(regexp_replace(lower(text), 'https?://[^{SP}]+|www\\.[^{SP}]+', '', 'g'), "
         f"'<.*?>', '', 'g'), '{PUNCT_SQL}', ''), '{tx.EMOJI}', '', 'g')")


@query("X09_clean_text", f"""
with {LEMMAS}, t as (select doc_id, w[p] as word, p from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from (
   select doc_id, list_filter(regexp_split_to_array({CLEAN}, {WORD}), lambda x: x <> '') as w from documents))),
 l as (select doc_id, p, coalesce(lemma, word) as word from t left join lemmas on word = form)
select doc_id, coalesce((select string_agg(word, ' ' order by p) from l where l.doc_id = d.doc_id
   and regexp_matches(word, '^\\p{{L}}+$') and not list_contains({STOP_SQL}, word)), '') as text from documents d""")
def x09(spark, sf):
    lemmas = cut_lineage(lemma_table(doc_tokens(spark, sf)))
    return ops.clean_text(docs(spark, sf), ["doc_id"], "text", STOPS, "lemma", lemmas)


# ---- counts, vocabularies, encoding -----------------------------------------

@query("A11_word_counts", f"select word, count(*) as cnt from {TOK} group by 1")
def a11(spark, sf):
    return ops.word_counts(doc_tokens(spark, sf), "tokens")


@query("A12_norm_freq", f"""
with c as (select doc_id, word, count(*) as cnt from {TOK} group by 1, 2)
select doc_id, word, cnt, {rnd_sql('cnt / max(cnt) over (partition by doc_id)', 6)} as freq from c""")
def a12(spark, sf):
    return ops.norm_freq(doc_tokens(spark, sf), "doc_id", "tokens").withColumn("freq", rnd("freq", 6))


RANKED = f"""(select word, cnt, row_number() over (order by cnt desc, first_doc, first_pos) as rank from (
  select word, count(*) as cnt, min(doc_id) as first_doc, arg_min(pos, doc_id * 1000000 + pos) as first_pos from {TOKPOS} group by word))"""


@query("T07_most_common", f"select * from {RANKED} where rank <= 100")
def t07(spark, sf):
    return ops.most_common(doc_tokens(spark, sf), "tokens", ["doc_id"], 100)


@query("U04_distinct_tokens", f"select distinct word as token from {TOK}")
def u04(spark, sf):
    return ops.distinct_tokens(doc_tokens(spark, sf), "tokens")


@query("X16_frequency_vocab", f"select word, rank as id from {RANKED} where rank <= 500 union all select '<UNK>', 501")
def x16(spark, sf):
    return ops.frequency_vocab(doc_tokens(spark, sf), "tokens", ["doc_id"], 500)


PIECES = f"(select conv_id, turn, regexp_split_to_array(lower(translate(text, '!@#$%^&*()''', '')), {WORD}) as tokens from conversations)"
FIRST_SEEN = f"""(select word, row_number() over (order by c, t, p) + 2 as id from (
  select word, min(s).c as c, min(s).t as t, min(s).p as p from (
    select tokens[p] as word, struct_pack(c := conv_id, t := turn, p := p) as s from
      (select *, unnest(range(1, len(tokens) + 1)) as p from {PIECES})) group by word)
  union all select '<PAD>', 0 union all select '<UNK>', 1)"""


def pieces(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.word_pieces(F.lower(tx.drop_chars("text"))).alias("tokens"))


@query("X17_first_seen_vocab", f"select word, id::bigint as id from {FIRST_SEEN}")
def x17(spark, sf):
    return ops.first_seen_vocab(pieces(spark, sf), "tokens", ["conv_id", "turn"])


@query("X18_set_vocab", f"""select word, (row_number() over (order by word) - 1)::bigint as id from (
  select distinct word from {TOK} union select unnest(['[PAD]', '[SEP]', '[CLS]', '[UNK]']))""")
def x18(spark, sf):
    return ops.set_vocab(doc_tokens(spark, sf), "tokens")


@query("X19_char_vocab", "select word, (row_number() over (order by word) - 1)::bigint as id from (select distinct unnest("
       "regexp_extract_all(text, '(?s).')) as word from documents)")
def x19(spark, sf):
    return ops.char_vocab(docs(spark, sf), "text")


@query("X19_char_encode", """
with v as (select word, (row_number() over (order by word) - 1)::bigint as id from (select distinct unnest(regexp_extract_all(text, '(?s).')) as word from conversations)),
 c as (select conv_id, turn, ch[p] as word, p from (select conv_id, turn, ch, unnest(range(1, len(ch) + 1)) as p from (
   select conv_id, turn, regexp_extract_all(text, '(?s).') as ch from conversations)))
select conv_id, turn, string_agg(id::varchar, ',' order by p) as ids from c join v using (word) group by 1, 2""")
def x19b(spark, sf):
    conv = table(spark, sf, "conversations")
    vocab = cut_lineage(ops.char_vocab(conv, "text"))
    chars = conv.select("conv_id", "turn", tx.characters("text").alias("chars"))
    out = ops.encode_tokens(chars, ["conv_id", "turn"], "chars", vocab)
    return out.select("conv_id", "turn", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


VOCAB500 = f"(select word, rank as id from {RANKED} where rank <= 500)"


def vocab500(spark, sf):
    return cut_lineage(ops.frequency_vocab(doc_tokens(spark, sf), "tokens", ["doc_id"], 500))


@query("J04_encode_tokens", f"""
select doc_id, coalesce(ids, '') as ids from documents left join (
  select doc_id, string_agg(coalesce(id, 501)::varchar, ',' order by pos) as ids
  from {TOKPOS} t left join {VOCAB500} v on t.word = v.word group by doc_id) using (doc_id)""")
def j04(spark, sf):
    tokens = doc_tokens(spark, sf)
    out = ops.encode_tokens(tokens, ["doc_id"], "tokens", vocab500(spark, sf), unk=501)
    return out.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("J05_decode_tokens", f"""
select doc_id, coalesce(tokens, '') as tokens from documents left join (
  select doc_id, string_agg(coalesce(v.word, '<UNK>'), ' ' order by pos) as tokens
  from {TOKPOS} t left join {VOCAB500} v on t.word = v.word group by doc_id) using (doc_id)""")
def j05(spark, sf):
    vocab = vocab500(spark, sf)
    tokens = doc_tokens(spark, sf)
    ids = ops.encode_tokens(tokens, ["doc_id"], "tokens", vocab, unk=501)
    return ops.decode_tokens(ids, ["doc_id"], "ids", vocab).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("J11_remove_stop_words", f"""
with s as (select word from {RANKED} where rank <= 25)
select doc_id, coalesce(kept, '') as kept from documents left join (
  select doc_id, string_agg(word, ' ' order by pos) as kept from {TOKPOS} where word not in (select word from s) group by doc_id) using (doc_id)""")
def j11(spark, sf):
    tokens = doc_tokens(spark, sf)
    stops = cut_lineage(ops.most_common(tokens, "tokens", ["doc_id"], 25).select("word"))
    out = ops.remove_stop_words(tokens, ["doc_id"], "tokens", stops)
    return out.select("doc_id", F.array_join("tokens", " ").alias("kept"))


PAD_SQL = "array_to_string({0}[1:32] || list_transform(range(32 - len({0}[1:32])), lambda i: '[PAD]'), ' ')"
PRE_SQL = "array_to_string(list_transform(range(32 - len({0}[1:32])), lambda i: '[PAD]') || {0}[1:32], ' ')"


@query("X20_pad_truncate", f"select conv_id, turn, {PAD_SQL.format('tokens')} as post, {PRE_SQL.format('tokens')} as pre from {CONV}")
def x20(spark, sf):
    return conv_tokens(spark, sf).select(
        "conv_id", "turn", *[F.array_join(tx.pad_truncate("tokens", 32, side, "[PAD]"), " ").alias(side) for side in ("post", "pre")])


ENCODED = f"""(select doc_id, coalesce(ids, []::bigint[]) as ids from documents left join (
  select doc_id, list(coalesce(id, 501) order by pos)::bigint[] as ids from {TOKPOS} t
  left join {VOCAB500} v on t.word = v.word group by doc_id) using (doc_id))"""


def _masks(df, key):
    return df.select(*key, *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
                             for c in ("input_ids", "attention_mask", "token_type_ids")])


@query("X21_encode_plus", f"""
with b as (select doc_id, [502] || ids[1:62] || [503] as body from {ENCODED})
select doc_id, array_to_string(body || list_transform(range(64 - len(body)), lambda i: 0), ',') as input_ids,
  array_to_string(list_transform(body, lambda i: 1) || list_transform(range(64 - len(body)), lambda i: 0), ',') as attention_mask,
  array_to_string(list_transform(range(64), lambda i: 0), ',') as token_type_ids from b""")
def x21(spark, sf):
    tokens = doc_tokens(spark, sf)
    return _masks(ops.encode_plus(tokens, ["doc_id"], "tokens", vocab500(spark, sf), 64, 502, 503, 501), ["doc_id"])


@query("X21_encode_pair", f"""
with t as (select conv_id, turn, unnest(range(1, len(tokens) + 1)) as p, tokens from {CONV}),
 w as (select conv_id, turn, list(coalesce(id, 501) order by p)::bigint[] as ids from t left join {VOCAB500} v on tokens[p] = v.word group by 1, 2),
 e as (select conv_id, turn, coalesce(ids, []::bigint[]) as ids from conversations left join w using (conv_id, turn)),
 p as (select a.conv_id, a.turn, a.ids as a, b.ids as b, len(a.ids) as na, len(b.ids) as nb from e a join e b on a.conv_id = b.conv_id and a.turn + 1 = b.turn),
 k as (select *, case when na + nb <= 61 then na when nb <= 30 then 61 - nb else least(na, 31) end as ka from p),
 l as (select conv_id, turn, [502] || a[1:ka] || [503] as l, b[1:61 - ka] || [503] as r from k)
select conv_id, turn, array_to_string(l || r || list_transform(range(64 - len(l) - len(r)), lambda i: 0), ',') as input_ids,
  array_to_string(list_transform(l || r, lambda i: 1) || list_transform(range(64 - len(l) - len(r)), lambda i: 0), ',') as attention_mask,
  array_to_string(list_transform(l, lambda i: 0) || list_transform(r, lambda i: 1) || list_transform(range(64 - len(l) - len(r)), lambda i: 0), ',') as token_type_ids
from l""")
def x21b(spark, sf):
    conv = conv_tokens(spark, sf)
    after = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("tokens").alias("reply"))
    pairs = conv.join(after, ["conv_id", "turn"])
    out = ops.encode_plus(pairs, ["conv_id", "turn"], "tokens", vocab500(spark, sf), 64, 502, 503, 501, pair="reply")
    return _masks(out, ["conv_id", "turn"])


@query("X22_roundtrip", f"""
with t as (select conv_id, turn, unnest(range(1, len(tokens) + 1)) as p, tokens from {CONV}),
 w as (select conv_id, turn, string_agg(coalesce(v.word, '<UNK>'), ' ' order by p) as tokens
       from t left join {VOCAB500} v on tokens[p] = v.word group by 1, 2)
select conv_id, turn, coalesce(tokens, '') as tokens from conversations left join w using (conv_id, turn)""")
def x22(spark, sf):
    conv = conv_tokens(spark, sf)
    out = ops.roundtrip(conv, ["conv_id", "turn"], "tokens", vocab500(spark, sf))
    return out.select("conv_id", "turn", F.array_join("tokens", " ").alias("tokens"))


# ---- windows of tokens ------------------------------------------------------

@query("W07_ngram_pairs", f"""
select tokens[i - 1] || ' ' || tokens[i] as context, tokens[i + 1] as target, count(*) as n
from (select tokens, unnest(range(2, len(tokens))) as i from (select {sql_words('text')} as tokens from documents)) group by 1, 2""")
def w07(spark, sf):
    pairs = doc_tokens(spark, sf).select(F.explode(tx.ngram_pairs("tokens", 2)).alias("g"))
    # One string is counted, not two columns: rows of the shuffle are shorter, and no word holds a space.
    counted = pairs.select(F.concat_ws(" ", "g.context", "g.target").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    return counted.select(F.substring_index("g", " ", 2).alias("context"), F.substring_index("g", " ", -1).alias("target"), "n")


@query("W08_token_windows", f"""
select conv_id, turn, s::int as start, md5(array_to_string(tokens[s + 1:s + 50], ' ')) as x, tokens[s + 51] as y
from (select *, unnest(range(0, len(tokens) - 50)) as s from {CONV})""")
def w08(spark, sf):
    w = conv_tokens(spark, sf).select("conv_id", "turn", F.explode(tx.token_windows("tokens", 51)).alias("w"))
    return w.select("conv_id", "turn", F.col("w.start").alias("start"), F.md5(F.array_join("w.x", " ")).alias("x"), F.col("w.y").alias("y"))


@query("M13_training_windows", f"""
select conv_id, turn, s::int as start, array_to_string(tokens[s + 1:s + 8], ' ') as x, array_to_string(tokens[s + 2:s + 9], ' ') as y
from (select *, unnest(range(0, len(tokens) - 8)) as s from {CONV})
order by md5(conv_id || '|' || turn || '|' || s || '|9'), conv_id, turn, s limit 256""")
def m13(spark, sf):
    from sparkloom.operators.sampling import sample_n
    w = conv_tokens(spark, sf).select("conv_id", "turn", F.explode(tx.shifted_windows("tokens", 8)).alias("w"))
    flat = w.select("conv_id", "turn", F.col("w.start").alias("start"), F.array_join("w.x", " ").alias("x"),
                    F.array_join("w.y", " ").alias("y"))
    return sample_n(flat, 256, ["conv_id", "turn", "start"], 9)


@query("W09_prefix_sequences", f"""
with e as (select conv_id, turn, list(id order by p) as ids from (
   select conv_id, turn, tokens[p] as word, p from (select *, unnest(range(1, len(tokens) + 1)) as p from {PIECES})) join {FIRST_SEEN} using (word) group by 1, 2),
 s as (select conv_id, turn, i, ids[1:least(i + 3, 64)] as k from (select *, unnest(range(1, len(ids))) as i from e)),
 f as (select conv_id, turn, i, list_transform(range(64 - len(k)), lambda z: 0::bigint) || k as padded from s)
select conv_id, turn, i::int as i, md5(array_to_string(padded[1:63], ',')) as x, padded[64]::bigint as y from f""")
def w09(spark, sf):
    tokens = pieces(spark, sf)
    vocab = cut_lineage(ops.first_seen_vocab(tokens, "tokens", ["conv_id", "turn"]))
    ids = ops.encode_tokens(tokens, ["conv_id", "turn"], "tokens", vocab, unk=1)
    p = ids.select("conv_id", "turn", F.explode(tx.prefix_sequences("ids")).alias("p"))
    return p.select("conv_id", "turn", F.col("p.i").alias("i"),
                    F.md5(F.array_join(F.col("p.x").cast("array<string>"), ",")).alias("x"), F.col("p.y").alias("y"))


# ---- weights and summaries --------------------------------------------------

TFIDF = f"""
tok as (select doc_id, unnest({sql_words('text', 2)}) as term from documents),
tf as (select doc_id, term, count(*) as tf from tok group by 1, 2),
nd as (select count(*) as n from documents),
st as (select term, count(*) as df, sum(tf) as total from tf group by 1),
vocab as (select term, ln((1 + n) / (1 + df)::double) + 1 as idf from st, nd where df >= 2 and df <= 0.6::double * n order by total desc, term limit 2000),
w as (select doc_id, term, tf * idf as w from tf join vocab using (term)),
tfidf as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from w)"""


@query("X24_tfidf", f"with {TFIDF} select doc_id, term, {rnd_sql('weight', 6)} as weight from tfidf")
def x24(spark, sf):
    tokens = doc_tokens(spark, sf, 2)
    vocab = cut_lineage(ops.tfidf_vocab(tokens, "doc_id", "tokens", 2, 0.6, 2000))
    return ops.tfidf(tokens, "doc_id", "tokens", vocab=vocab).withColumn("weight", rnd("weight", 6))


SENT = f"""
sen as (select doc_id, pos, s[pos + 1] as sentence from (select doc_id, s, unnest(range(len(s))) as pos from (
    select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[{SP}]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as s from documents)))"""


@query("T05_top_fraction", f"""
with {SENT}, r as (select doc_id, pos, len(sentence) as score, row_number() over (partition by doc_id order by len(sentence) desc, pos) as rank,
  count(*) over (partition by doc_id) as n from sen)
select doc_id, pos::int as pos, score::int as score, rank::int as rank from r where rank <= floor(n * 0.3::double)""")
def t05(spark, sf):
    s = docs(spark, sf).select("doc_id", F.posexplode(tx.split_sentences("text")).alias("pos", "s"))
    return ops.top_fraction(s.select("doc_id", "pos", F.length("s").alias("score")), "doc_id", "score", 0.3, "pos")


@query("X23_summarize", f"""
with {SENT},
 t as (select doc_id, pos, unnest(list_filter({sql_words('sentence')}, lambda t: regexp_matches(t, '^\\p{{L}}+$'))) as word from sen),
 f as (select doc_id, word, count(*) as c from t group by 1, 2),
 g as (select doc_id, word, c / max(c) over (partition by doc_id) as freq from f),
 sc as (select doc_id, pos, round(sum(freq), 9) as score from t join g using (doc_id, word) group by 1, 2),
 r as (select *, row_number() over (partition by doc_id order by score desc, pos) as rk, count(*) over (partition by doc_id) as n from sc),
 o as (select doc_id, string_agg(sentence, ' ' order by rk) as summary, count(*)::int as sentences
       from r join sen using (doc_id, pos) where rk <= floor(n * 0.3::double) group by 1)
select d.doc_id, coalesce(summary, '') as summary, coalesce(sentences, 0)::int as sentences from documents d left join o using (doc_id)""")
def x23(spark, sf):
    return ops.summarize(docs(spark, sf), "doc_id", "text")


# ---- next-word suggestion ---------------------------------------------------

NGRAMS = f"""
g as (select 1 as size, tokens[i] as context, tokens[i + 1] as next from (select tokens, unnest(range(1, len(tokens))) as i from {CONV})
  union all select 2, tokens[i - 1] || ' ' || tokens[i], tokens[i + 1] from (select tokens, unnest(range(2, len(tokens))) as i from {CONV})),
c as (select size, context, next, count(*) as cnt from g group by all),
model as (select *, row_number() over (partition by size, context order by cnt desc, next) as rank from c)"""


@query("X25_fit_ngrams", f"with {NGRAMS} select size::int as size, context, next, cnt, rank::int as rank from model where rank <= 3")
def x25(spark, sf):
    return ops.fit_ngrams(conv_tokens(spark, sf), "tokens", 2)


def _step(prev):
    return f"""(select conv_id, turn, t || [coalesce(b2.next, b1.next)] as t, said || [coalesce(b2.next, b1.next)] as said from (
  select *, t[len(t)] as l1, case when len(t) > 1 then t[len(t) - 1] || ' ' || t[len(t)] end as l2 from {prev}) p
  left join model b2 on b2.size = 2 and b2.rank = 1 and b2.context = l2 left join model b1 on b1.size = 1 and b1.rank = 1 and b1.context = l1)"""


@query("X25_suggest", f"""with {NGRAMS} select conv_id, turn, coalesce(array_to_string(list_filter(said, lambda x: x is not null), ' '), '') as suggested from """
       + _step(_step(f"(select conv_id, turn, tokens as t, []::varchar[] as said from {CONV})")))
def x25b(spark, sf):
    conv = conv_tokens(spark, sf)
    model = cut_lineage(ops.fit_ngrams(conv, "tokens", 2, k=1))
    out = ops.suggest(conv, ["conv_id", "turn"], "tokens", model, 2, steps=2)
    return out.select("conv_id", "turn", F.array_join("suggested", " ").alias("suggested"))
