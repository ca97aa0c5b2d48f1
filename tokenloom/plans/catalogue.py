"""The registered queries over the driver's tables, each with its SQL where SQL can say it.

Each reads only the columns it needs and is narrow up to its last aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytelevel, decoders, normalizers, splitters
from ..functions.patterns import BYTE_LEVEL_PATTERN, CASED_PATTERN, RANK_PATTERN, find_all, match_offsets
from ..operators import vocabulary as vocab
from ..operators.segments import segments, special_ids
from ..sources import artifacts
from ..api import HFTokenizer, SentencePiece, Tiktoken
from . import toy

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- pieces
def pieces_by_lang(spark, sf, pattern=RANK_PATTERN):
    docs = table(spark, sf, "documents", "lang", "text").select("lang", find_all(F.col("text"), pattern).alias("p"))
    sizes = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    return docs.groupBy("lang").agg(F.sum(F.size("p").cast("long")).alias("n_pieces"), F.sum(sizes).alias("n_bytes"), F.max(F.array_max(F.transform("p", F.octet_length))).cast("long").alias("longest"))


def pieces_by_lang_sql(pattern=RANK_PATTERN):
    return f"SELECT lang, sum(len(p))::BIGINT AS n_pieces, sum(list_sum(list_transform(p, lambda x: strlen(x))))::BIGINT AS n_bytes, max(list_max(list_transform(p, lambda x: strlen(x))))::BIGINT AS longest FROM (SELECT lang, regexp_extract_all(text, {quote(pattern)}) AS p FROM documents) GROUP BY lang"


def top_pieces(spark, sf):
    p = table(spark, sf, "documents", "text").select(F.explode(find_all(F.col("text"), RANK_PATTERN)).alias("piece"))
    return p.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "piece").limit(50)


TOP_PIECES = f"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {quote(RANK_PATTERN)})) AS piece FROM documents) GROUP BY piece ORDER BY n DESC, piece LIMIT 50"


def piece_lengths(spark, sf):
    p = table(spark, sf, "documents", "text").select(F.explode(F.transform(find_all(F.col("text"), RANK_PATTERN), F.octet_length)).alias("n_bytes"))
    return p.groupBy(F.col("n_bytes").cast("long").alias("n_bytes")).agg(F.count(F.lit(1)).alias("n"))


PIECE_LENGTHS = f"SELECT n_bytes, count(*) AS n FROM (SELECT strlen(unnest(regexp_extract_all(text, {quote(RANK_PATTERN)})))::BIGINT AS n_bytes FROM documents) GROUP BY n_bytes"


def joined(name: str, cut) -> Query:
    def run(spark, sf):
        rows = table(spark, sf, "conversations", "conv_id", "turn", "text")
        pieces = cut(F.col("text"))
        return rows.select("conv_id", "turn", F.size(pieces).cast("long").alias("n"), F.array_join(pieces, "|").alias("pieces"))

    run.__name__ = name
    return run


def joined_sql(expression: str) -> str:
    return f"SELECT conv_id, turn, len(p)::BIGINT AS n, array_to_string(p, '|') AS pieces FROM (SELECT conv_id, turn, {expression} AS p FROM conversations)"


def digit_pieces(spark, sf):
    rows = table(spark, sf, "events", "event_id", F.concat(F.col("event_type"), F.lit(" "), F.col("event_id"), F.lit(":"), F.coalesce("props", F.lit(""))).alias("t"))
    each, run = splitters.digits(F.col("t"), individual=True), splitters.digits(F.col("t"))
    return rows.select("event_id", F.array_join(each, "|").alias("each"), F.array_join(run, "|").alias("runs"))


DIGIT_PIECES = r"""SELECT event_id, array_to_string(regexp_extract_all(t, '[^\p{N}]+|\p{N}'), '|') AS "each", array_to_string(regexp_extract_all(t, '[^\p{N}]+|[\p{N}]+'), '|') AS runs
FROM (SELECT event_id, event_type || ' ' || event_id || ':' || coalesce(props, '') AS t FROM events)"""


def piece_offsets(spark, sf):
    rows = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.posexplode(match_offsets(F.col("text"), r"\w+")).alias("i", "o"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("o.start").alias("starts"), F.sum("o.end").alias("ends"))


PIECE_OFFSETS = r"""
WITH x AS (SELECT doc_id, regexp_extract_all(text, '\w+') AS m, regexp_split_to_array(text, '\w+') AS g FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda y: strlen(y))) AS lm, unnest(list_transform(g[1:len(m)], lambda y: strlen(y))) AS lg FROM x),
c AS (SELECT doc_id, lm, sum(lm + lg) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM u)
SELECT doc_id, count(*) AS n, sum(e - lm)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM c GROUP BY doc_id"""


def character_widths(spark, sf):
    rows = table(spark, sf, "documents", "lang", "text").select("lang", F.explode(F.transform(F.split("text", ""), F.octet_length)).alias("width"))
    return rows.where("width > 0").groupBy("lang", F.col("width").cast("long").alias("width")).agg(F.count(F.lit(1)).alias("n"))


CHARACTER_WIDTHS = "SELECT lang, width, count(*) AS n FROM (SELECT lang, strlen(unnest(string_split(text, '')))::BIGINT AS width FROM documents) WHERE width > 0 GROUP BY lang, width"


def long_input_parts(spark, sf):
    rows = table(spark, sf, "documents", "doc_id", "text")
    parts = splitters.long_input_parts(F.col("text"), most_chars=2000, most_run=12)
    return rows.select("doc_id", F.size(parts).cast("long").alias("n_parts"), F.md5(F.array_join(parts, "")).alias("digest"))


#: A run of n characters of one kind is cut (n - 1) // 12 times in each part.
LONG_INPUT_PARTS = r"""SELECT doc_id, sum(n)::BIGINT AS n_parts, any_value(md5(text)) AS digest FROM (
SELECT doc_id, text, CASE WHEN length(text) <= 12 THEN 1 ELSE 1 + list_sum(list_transform(regexp_extract_all(part, '\s+|\S+'), lambda r: (length(r) - 1) // 12)) END AS n FROM (
SELECT doc_id, text, unnest(list_transform(range(0, greatest(length(text), 1), 2000), lambda i: substr(text, (i + 1)::INT, 2000))) AS part FROM documents)) GROUP BY doc_id"""


# --- normalizers
def normalized(name: str, spec: dict, text=lambda: F.col("text")) -> Query:
    def run(spark, sf):
        rows = table(spark, sf, "documents", "doc_id", "text").select("doc_id", normalizers.compile_normalizer(spec)(F.array(text()))[0].alias("t"))
        return rows.select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.encode("t", "UTF-8")).alias("digest"))

    run.__name__ = name
    return run


def normalized_sql(expression: str) -> str:
    return f"SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS digest FROM (SELECT doc_id, {expression} AS t FROM documents)"


# --- specials
def wrapped_turns(spark, sf):
    user = F.concat(F.lit("[INST]"), "text", F.lit("[/INST]"))
    return table(spark, sf, "conversations", "conv_id", "turn", F.when(F.col("role") == "user", user).otherwise(F.concat("text", F.lit("</s>"))).alias("t"))


def special_segments(spark, sf):
    specials = toy.rank_artifact().specials
    out = wrapped_turns(spark, sf).select("conv_id", "turn", F.posexplode(segments(F.col("t"), specials)).alias("pos", "segment"))
    return out.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "segment", F.coalesce(F.element_at(special_ids(specials), F.col("segment")), F.lit(-1)).cast("long").alias("special_id"))


def special_segments_sql() -> str:
    ids = "".join(f"WHEN '{s}' THEN {i} " for s, i in toy.rank_artifact().specials.items())
    return rf"""SELECT conv_id, turn, pos::BIGINT AS pos, segment, (CASE segment {ids} ELSE -1 END)::BIGINT AS special_id FROM (
SELECT conv_id, turn, unnest(s) AS segment, unnest(range(len(s))) AS pos FROM (
SELECT conv_id, turn, regexp_extract_all(CASE WHEN role = 'user' THEN '[INST]' || text || '[/INST]' ELSE text || '</s>' END, '(?s)\[INST\]|\[/INST\]|</s>|<s>|[^<\[]+|.') AS s FROM conversations))"""


# --- byte alphabet
def byte_alphabet(spark, sf):
    rows = table(spark, sf, "conversations", "conv_id", "turn", "text")
    printable = bytelevel.to_printable(F.col("text"))
    return rows.select("conv_id", "turn", F.length(printable).cast("long").alias("n"), printable.alias("printable"))


def byte_alphabet_sql() -> str:
    chars = "[" + ", ".join(f"chr({ord(c)})" for c in bytelevel.ALPHABET) + "]"
    return f"""SELECT conv_id, turn, strlen(text)::BIGINT AS n, array_to_string(list_transform(range(1, strlen(text) + 1), lambda i: c[('0x' || substr(h, (2 * i - 1)::INT, 2))::INT + 1]), '') AS printable
FROM (SELECT conv_id, turn, text, hex(encode(text)) AS h, {chars} AS c FROM conversations)"""


def byte_alphabet_round_trip(spark, sf):
    rows = table(spark, sf, "documents", "doc_id", "text")
    back = decoders.compile_decoder({"type": "ByteLevel"}, whole_columns=True)(bytelevel.printable_rows(F.col("text")))
    return rows.select("doc_id", F.md5(back).alias("digest"))


def fallback_bytes(spark, sf):
    rows = table(spark, sf, "customer", "c_custkey")
    k = F.col("c_custkey")
    token = F.when(k % 5 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.concat(F.lit("<0x"), F.lpad(F.hex(k % 256), 2, "0"), F.lit(">")))
    return rows.select("c_custkey", token.alias("token"), F.hex(decoders.byte_fallback(token)).alias("bytes"))


FALLBACK_BYTES = """SELECT c_custkey, token, CASE WHEN c_custkey % 5 <> 0 THEN printf('%02X', v) ELSE hex(encode(token)) END AS bytes FROM (
SELECT c_custkey, c_custkey % 256 AS v, CASE WHEN c_custkey % 5 = 0 THEN 'x' || c_custkey ELSE '<0x' || printf('%02X', c_custkey % 256) || '>' END AS token FROM customer)"""


def replaced_tokens(spark, sf):
    rows = table(spark, sf, "customer", "c_custkey", F.concat(F.lit("▁"), F.replace(F.col("c_name"), F.lit("#"), F.lit("▁"))).alias("token"))
    decode = decoders.compile_decoder({"type": "Sequence", "decoders": [{"type": "Replace", "pattern": {"String": "▁"}, "content": " "}, {"type": "ByteFallback"}, {"type": "Fuse"}]})
    return rows.select("c_custkey", decode(F.col("token")).cast("string").alias("text"))


# --- rank lines
def rank_lines(spark, sf):
    k = F.col("c_custkey")
    good = F.regexp_replace(F.base64(F.encode("c_name", "UTF-8")), r"\s", "")
    left = F.when(k % 7 == 1, F.concat(good, F.lit("*"))).when(k % 7 == 2, F.expr("substring(c_name, 1, 3)")).otherwise(good)
    right = F.when(k % 11 == 3, F.lit("18446744073709551616")).when(k % 11 == 4, F.lit("abc")).otherwise(k.cast("string"))
    lines = table(spark, sf, "customer", "c_custkey", F.concat(left, F.when(k % 13 == 5, "").otherwise(" "), right).alias("value"))
    rows = artifacts.parsed_rank_lines(lines.select("value"))
    return rows.groupBy(F.coalesce("error", F.lit("Ok")).alias("error")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids"), F.coalesce(F.max(F.hex("token")), F.lit("")).alias("token"))


RANK_LINES = r"""
WITH l AS (SELECT CASE c_custkey % 7 WHEN 1 THEN to_base64(encode(c_name)) || '*' WHEN 2 THEN substr(c_name, 1, 3) ELSE to_base64(encode(c_name)) END
 || CASE WHEN c_custkey % 13 = 5 THEN '' ELSE ' ' END || CASE c_custkey % 11 WHEN 3 THEN '18446744073709551616' WHEN 4 THEN 'abc' ELSE c_custkey::VARCHAR END AS v FROM customer),
p AS (SELECT v, strpos(v, ' ') AS sp, split_part(v, ' ', 1) AS a, substr(v, strpos(v, ' ') + 1) AS b FROM l),
e AS (SELECT *, CASE WHEN sp = 0 THEN 'ParseFailure' WHEN NOT regexp_full_match(a, '(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{2}==)') THEN 'Base64DecodeFailure'
 WHEN try_cast(b AS BIGINT) IS NULL THEN 'EncodeFailure' END AS error FROM p)
SELECT coalesce(error, 'Ok') AS error, count(*) AS n, coalesce(sum(CASE WHEN error IS NULL THEN b::BIGINT END), 0)::BIGINT AS ids, coalesce(max(CASE WHEN error IS NULL THEN hex(from_base64(a)) END), '') AS token FROM e GROUP BY error"""


def duplicate_tokens(spark, sf):
    rows = table(spark, sf, "part", F.encode(F.substring_index("p_name", " ", 1), "UTF-8").alias("token"), F.col("p_partkey").alias("id"))
    return artifacts.check_bijection(rows)


DUPLICATE_TOKENS = """SELECT 'token' AS kind, hex(encode(split_part(p_name, ' ', 1))) AS key, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'id', p_partkey::VARCHAR, count(*) FROM part GROUP BY ALL HAVING count(*) > 1"""


# --- vocabulary relations
def toy_tables(spark):
    a = toy.rank_artifact()
    return a.vocabulary(spark), a.special_table(spark)


def values_of(tokens: dict[bytes, int]) -> str:
    return "(VALUES " + ", ".join(f"('{t.hex().upper()}', {i})" for t, i in tokens.items()) + ")"


def whole_pieces(spark, sf):
    tokens, _ = toy_tables(spark)
    p = table(spark, sf, "documents", "lang", "text").select("lang", F.explode(F.transform(find_all(F.col("text"), RANK_PATTERN), lambda p: F.encode(p, "UTF-8"))).alias("token"))
    return vocab.look_up_tokens(p, tokens).groupBy("lang").agg(F.count(F.lit(1)).alias("n_pieces"), F.count("id").alias("n_whole"))


def whole_pieces_sql() -> str:
    return f"""SELECT lang, count(*) AS n_pieces, count(v.id) AS n_whole FROM (SELECT lang, hex(encode(unnest(regexp_extract_all(text, {quote(RANK_PATTERN)})))) AS t FROM documents)
LEFT JOIN {values_of(toy.rank_tokens())} v(tok, id) ON t = tok GROUP BY lang"""


def merge_rows(spark):
    tokens, merges = toy.character_merges()
    merges = [*merges, merges[0], ("zz", "z"), ("Ġt", "he")]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "position long, first string, second string"), spark.createDataFrame(list(tokens.items()), "token string, id long")


def merge_rules(spark, sf):
    merges, tokens = merge_rows(spark)
    return vocab.resolve_merges(merges, tokens)


def least_merge_ranks(spark, sf):
    merges, tokens = merge_rows(spark)
    return vocab.merge_ranks(vocab.resolve_merges(merges, tokens))


def merges_sql(last: str) -> str:
    tokens, merges = toy.character_merges()
    merges = [*merges, merges[0], ("zz", "z"), ("Ġt", "he")]
    m = ", ".join(f"({i}, {quote(a)}, {quote(b)})" for i, (a, b) in enumerate(merges))
    v = ", ".join(f"({quote(t)}, {i})" for t, i in tokens.items())
    return f"""WITH m(position, a, b) AS (VALUES {m}), v(t, id) AS (VALUES {v}),
r AS (SELECT position, x.id AS first_id, y.id AS second_id, a || b AS merged, z.id AS merged_id, row_number() OVER (PARTITION BY x.id, y.id ORDER BY position) AS n
FROM m JOIN v x ON a = x.t JOIN v y ON b = y.t JOIN v z ON a || b = z.t) {last}"""


def regular_tokens(spark, sf):
    tokens, _ = toy_tables(spark)
    specials = table(spark, sf, "nation", F.col("n_name").alias("token"), (F.col("n_nationkey") * 11).alias("id"))
    rest = vocab.without_specials(tokens, specials)
    return rest.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.max(F.octet_length("token")).cast("long").alias("longest"))


def regular_tokens_sql() -> str:
    return f"SELECT count(*) AS n, sum(id)::BIGINT AS ids, max(length(tok) // 2)::BIGINT AS longest FROM {values_of(toy.rank_tokens())} v(tok, id) WHERE id NOT IN (SELECT n_nationkey * 11 FROM nation)"


def special_table(spark, sf):
    return spark.createDataFrame(artifacts.special_slots(list(enumerate(artifacts.DEFAULT_TEKKEN_SPECIALS)), 40), "rank long, token string")


SPECIAL_TABLE = "SELECT i::BIGINT AS rank, coalesce(([" + ", ".join(quote(s) for s in artifacts.DEFAULT_TEKKEN_SPECIALS) + "])[i + 1], '<SPECIAL_' || i || '>') AS token FROM range(40) r(i)"


# --- encode and decode
def encoded(spark, sf) -> DataFrame:
    rows = table(spark, sf, "conversations", "conv_id", "turn", "text")
    return toy.rank_tokenizer(spark).encode_df(rows, "text", bos=1, eos=2)


def encode_ids(spark, sf):
    return encoded(spark, sf).select("conv_id", "turn", F.size("ids").cast("long").alias("n_ids"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def token_histogram(spark, sf):
    return encoded(spark, sf).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def encode_sql(last: str, source: str = "SELECT conv_id, turn, text AS segment, -1 AS special_id, 0 AS place FROM conversations") -> str:
    """Ids by rank merges of segments (conv_id, turn, segment, special_id, place) in order of ``place``."""
    a = toy.rank_artifact()
    return f"""
WITH RECURSIVE m AS (SELECT map(list(tok), list(id)) AS m FROM {values_of(a.tokens)} v(tok, id)),
g AS ({source}),
p AS (SELECT conv_id, turn, place, special_id, unnest(x) AS piece, unnest(range(len(x))) AS pos FROM (SELECT *, CASE WHEN special_id >= 0 THEN [''] ELSE regexp_extract_all(segment, {quote(RANK_PATTERN)}) END AS x FROM g)),
s(h, parts, best) AS (
  SELECT h, parts, list_min(list_filter(list_transform(range(1, len(parts)), lambda i: {{'r': m[parts[i] || parts[i + 1]], 'i': i}}), lambda y: y.r IS NOT NULL))
  FROM (SELECT h, list_transform(range(1, length(h) // 2 + 1), lambda i: substr(h, (2 * i - 1)::INT, 2)) AS parts FROM (SELECT DISTINCT hex(encode(piece)) AS h FROM p)), m
  UNION ALL
  SELECT h, parts, list_min(list_filter(list_transform(range(1, len(parts)), lambda i: {{'r': m[parts[i] || parts[i + 1]], 'i': i}}), lambda y: y.r IS NOT NULL))
  FROM (SELECT h, parts[1:best.i - 1] || [parts[best.i] || parts[best.i + 1]] || parts[best.i + 2:] AS parts FROM s WHERE best IS NOT NULL), m),
e AS (SELECT h, list_transform(parts, lambda q: m[q]) AS ids FROM s, m WHERE best IS NULL),
d AS (SELECT conv_id, turn, flatten(list(CASE WHEN special_id >= 0 THEN [special_id::INT] ELSE ids END ORDER BY place, pos)) AS ids FROM p JOIN e ON hex(encode(piece)) = h GROUP BY conv_id, turn),
t AS (SELECT conv_id, turn, [{a.bos}] || ids || [{a.eos}, {a.eos}] AS ids FROM d) {last}"""


IDS = "SELECT conv_id, turn, len(ids)::BIGINT AS n_ids, array_to_string(ids, ' ') AS ids FROM t"


def special_encode(spark, sf):
    """Turns wrapped in special strings, which become ids of their own."""
    rows = wrapped_turns(spark, sf)
    out = toy.rank_tokenizer(spark).encode_df(rows, "t", bos=1, eos=2)
    return out.select("conv_id", "turn", F.size("ids").cast("long").alias("n_ids"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def token_bytes(spark, sf):
    """The bytes behind the ids of all turns, by a join."""
    a = toy.rank_artifact()
    return vocab.look_up_ids(token_histogram(spark, sf), a.vocabulary(spark), a.special_table(spark)).select("id", "n", F.hex("piece").alias("bytes"))


def token_bytes_sql() -> str:
    a = toy.rank_artifact()
    every = a.tokens | {s.encode(): i for s, i in a.specials.items()}
    return encode_sql(f"SELECT id::BIGINT AS id, n, tok AS bytes FROM (SELECT id, count(*) AS n FROM (SELECT unnest(ids) AS id FROM t) GROUP BY id) JOIN {values_of(every)} v(tok, i) ON i = id")


def vocabulary_elements(spark, sf):
    return toy.rank_tokenizer(spark).elements().select("index", "id", F.hex("token").alias("token"))


def vocabulary_elements_sql() -> str:
    return f"SELECT row_number() OVER (ORDER BY id) - 1 AS index, id::BIGINT AS id, tok AS token FROM {values_of(toy.rank_tokens())} v(tok, id)"


# --- whole vocabularies, over all documents
def public_file(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_round_trip(name: str, make, text=lambda: F.col("text"), skip: int = 0, **options) -> Query:
    """Encodes and decodes every document; the digest is that of the decoded text less its first ``skip`` bytes."""

    def run(spark, sf):
        t = make(spark)
        ids = t.encode_df(table(spark, sf, "documents", "doc_id", text().alias("text")), **options).select("doc_id", "ids")
        out = t.decode_df(ids)
        return out.select(F.col("doc").alias("doc_id"), F.md5(F.expr(f"substring(data, {skip + 1})")).alias("digest"), (F.col("n_tokens") > options.get("bos", 0)).alias("has_tokens"))

    run.__name__ = name
    return run


#: A piece with a character of id 0 that is no token as a whole is dropped by rule, and ``!`` has id 0 in this vocabulary.
json_vocabulary = vocabulary_round_trip("json_vocabulary", lambda s: HFTokenizer(s).load(public_file("byte_bpe_50k.json")), lambda: F.replace("text", F.lit("!"), F.lit(".")))
rank_vocabulary = vocabulary_round_trip("rank_vocabulary", lambda s: Tiktoken(s).load(public_file("byte_bpe_50k.tiktoken")))
piece_vocabulary = vocabulary_round_trip("piece_vocabulary", lambda s: SentencePiece(s, exact=True).load(public_file("piece_bpe_32k.model")), skip=1, bos=1)


def round_trip_sql(text: str = "text") -> str:
    return f"SELECT doc_id, md5({text}) AS digest, length(text) > 0 AS has_tokens FROM documents"


def decode_round_trip(spark, sf):
    t = toy.rank_tokenizer(spark)
    rows = encoded(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.slice("ids", 2, F.size("ids") - 3).alias("ids"))
    return t.decode_df(rows).select(F.col("doc").alias("doc_id"), "n_tokens", F.md5("data").alias("digest"))


def byte_level_encode(spark, sf):
    rows = table(spark, sf, "conversations", "conv_id", "turn", "text")
    return toy.hf_tokenizer(spark).encode_df(rows, "text", bos=1).select("conv_id", "turn", F.size("ids").cast("long").alias("n_ids"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), "dropped_pieces")


def byte_level_sql() -> str:
    """By character merges over the printable alphabet.  White space stands alone in the turns, so the pattern's lookahead decides nothing."""
    tokens, merges = toy.character_merges()
    _, ranks = artifacts.resolved_merges(tokens, merges)
    named = lambda d: f"map([{', '.join(map(quote, d))}], [{', '.join(map(str, d.values()))}])"
    chars = "[" + ", ".join(f"chr({ord(c)})" for c in bytelevel.ALPHABET) + "]"
    pattern = BYTE_LEVEL_PATTERN.replace(r"\s+(?!\S)|", "")
    pairs = "list_min(list_filter(list_transform(range(1, len(parts)), lambda i: {'r': r[parts[i] || parts[i + 1]], 'i': i}), lambda y: y.r IS NOT NULL))"
    return f"""
WITH RECURSIVE m AS (SELECT {named(tokens)} AS m, {named(ranks)} AS r, {chars} AS c),
p AS (SELECT conv_id, turn, unnest(x) AS piece, unnest(range(len(x))) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(text, {quote(pattern)}) AS x FROM conversations)),
s(h, parts, best) AS (
  SELECT h, parts, {pairs} FROM (SELECT h, list_transform(range(1, length(h) // 2 + 1), lambda i: c[('0x' || substr(h, (2 * i - 1)::INT, 2))::INT + 1]) AS parts FROM (SELECT DISTINCT hex(encode(piece)) AS h FROM p), m), m
  UNION ALL
  SELECT h, parts, {pairs} FROM (SELECT h, parts[1:best.i - 1] || [parts[best.i] || parts[best.i + 1]] || parts[best.i + 2:] AS parts FROM s WHERE best IS NOT NULL), m),
e AS (SELECT h, CASE WHEN m[array_to_string(parts, '')] IS NOT NULL THEN [m[array_to_string(parts, '')]] ELSE list_transform(parts, lambda q: m[q]) END AS ids FROM s, m WHERE best IS NULL),
t AS (SELECT conv_id, turn, [0] || flatten(list(ids ORDER BY pos)) AS ids FROM p JOIN e ON hex(encode(piece)) = h GROUP BY conv_id, turn)
SELECT conv_id, turn, len(ids)::BIGINT AS n_ids, array_to_string(ids, ' ') AS ids, 0 AS dropped_pieces FROM t"""


def scored_encode(spark, sf):
    rows = table(spark, sf, "conversations", "conv_id", "turn", "text")
    out = toy.scored_tokenizer(spark).encode_df(rows, "text", bos=1, eos=1)
    return out.select("conv_id", "turn", F.size("ids").cast("long").alias("n_ids"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def scored_round_trip(spark, sf):
    t = toy.scored_tokenizer(spark)
    rows = table(spark, sf, "conversations", "conv_id", "turn", "text")
    ids = t.encode_df(rows, "text", bos=1).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "ids")
    out = t.decode_df(ids)
    # the begin token's own text stands in front
    return out.select(F.col("doc").alias("doc_id"), F.md5(F.encode(F.expr("substring(text, 4)"), "UTF-8")).alias("digest"))


PAIRS: dict[str, tuple[Query, str | None]] = {
    "pieces_by_lang": (pieces_by_lang, pieces_by_lang_sql()),
    "cased_pieces_by_lang": (lambda s, d: pieces_by_lang(s, d, CASED_PATTERN), pieces_by_lang_sql(CASED_PATTERN)),
    "top_pieces": (top_pieces, TOP_PIECES),
    "piece_lengths": (piece_lengths, PIECE_LENGTHS),
    "split_removed": (joined("split_removed", lambda c: splitters.split_removed(c, " ")), joined_sql("list_filter(string_split(text, ' '), lambda x: x <> '')")),
    "split_isolated": (joined("split_isolated", lambda c: splitters.split_isolated(c, "th")), joined_sql("list_filter(flatten(list_transform(string_split(text, 'th'), lambda x, i: CASE WHEN i = 1 THEN [x] ELSE ['th', x] END)), lambda x: x <> '')")),
    "split_merged_with_previous": (joined("split_merged_with_previous", lambda c: splitters.split_merged_with_previous(c, " ")), joined_sql("regexp_extract_all(text, '[^ ]* |[^ ]+')")),
    "digit_pieces": (digit_pieces, DIGIT_PIECES),
    "piece_offsets": (piece_offsets, PIECE_OFFSETS),
    "character_widths": (character_widths, CHARACTER_WIDTHS),
    "long_input_parts": (long_input_parts, LONG_INPUT_PARTS),
    "replace_text": (normalized("replace_text", {"type": "Sequence", "normalizers": [{"type": "Replace", "pattern": {"String": " "}, "content": "▁"}, {"type": "Replace", "pattern": {"String": "e"}, "content": "$1"}]}), normalized_sql("replace(replace(text, ' ', '▁'), 'e', '$1')")),
    "replace_regex": (normalized("replace_regex", {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": "_"}), normalized_sql(r"regexp_replace(text, '\s+', '_', 'g')")),
    "nfc": (normalized("nfc", {"type": "NFC"}, lambda: F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü"))), normalized_sql("nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)))")),
    "special_segments": (special_segments, special_segments_sql()),
    "byte_alphabet": (byte_alphabet, byte_alphabet_sql()),
    "byte_alphabet_round_trip": (byte_alphabet_round_trip, "SELECT doc_id, md5(text) AS digest FROM documents"),
    "fallback_bytes": (fallback_bytes, FALLBACK_BYTES),
    "replaced_tokens": (replaced_tokens, "SELECT c_custkey, ' ' || replace(c_name, '#', ' ') AS text FROM customer"),
    "rank_lines": (rank_lines, RANK_LINES),
    "duplicate_tokens": (duplicate_tokens, DUPLICATE_TOKENS),
    "whole_pieces": (whole_pieces, whole_pieces_sql()),
    "merge_rules": (merge_rules, merges_sql("SELECT position::BIGINT AS rank, first_id::BIGINT AS first_id, second_id::BIGINT AS second_id, merged, merged_id::BIGINT AS merged_id FROM r WHERE n = 1")),
    "least_merge_ranks": (least_merge_ranks, merges_sql("SELECT merged, min(position)::BIGINT AS rank FROM r WHERE n = 1 GROUP BY merged")),
    "regular_tokens": (regular_tokens, regular_tokens_sql()),
    "special_table": (special_table, SPECIAL_TABLE),
    "encode_ids": (encode_ids, encode_sql(IDS)),
    "special_encode": (special_encode, encode_sql(IDS, f"SELECT conv_id, turn, segment, special_id, pos AS place FROM ({special_segments_sql()})")),
    "token_bytes": (token_bytes, token_bytes_sql()),
    "vocabulary_elements": (vocabulary_elements, vocabulary_elements_sql()),
    "json_vocabulary": (json_vocabulary, round_trip_sql("replace(text, '!', '.')")),
    "rank_vocabulary": (rank_vocabulary, round_trip_sql()),
    "piece_vocabulary": (piece_vocabulary, round_trip_sql()),
    "token_histogram": (token_histogram, encode_sql("SELECT id::BIGINT AS id, count(*) AS n FROM (SELECT unnest(ids) AS id FROM t) GROUP BY id")),
    "decode_round_trip": (decode_round_trip, encode_sql("SELECT (c.conv_id * 1000 + c.turn)::BIGINT AS doc_id, (len(ids) - 3)::BIGINT AS n_tokens, md5(text) AS digest FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn")),
    "byte_level_encode": (byte_level_encode, byte_level_sql()),
    "scored_encode": (scored_encode, None),
    "scored_round_trip": (scored_round_trip, "SELECT (conv_id * 1000 + turn)::BIGINT AS doc_id, md5(text) AS digest FROM conversations"),
}


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in PAIRS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PAIRS.items() if sql is not None}
