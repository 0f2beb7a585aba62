"""Queries of the core operators: name -> (spark, folder of tables) -> DataFrame, and the same results in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import arbitrate as A
from ..operators import dataset as D
from ..operators import decode, domains, entities, layout, lexicon, models, pages, raster, stats
from ..operators import geometry as G
from ..sources import files as R
from ..sources import sinks as W
from ..streaming import results as S
from .persist import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it can be said so."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


# --- text functions

_FOLD = "translate(strip_accents({0}), 'đĐ', 'dD')"


@query(f"SELECT line_id, {_FOLD.format('text')} AS folded FROM train")
def accent_fold(spark, folder):
    return read(spark, folder, "train").select("line_id", T.remove_accents("text").alias("folded"))


@query("SELECT line_id, nfc_normalize(text) AS composed FROM train")
def compose_text(spark, folder):
    return read(spark, folder, "train").select("line_id", T.nfc("text").alias("composed"))


_TYPO = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(full_text, '\s+([:,.?!;])', '\1', 'g'),
    '([,:])([^\s0-9/])', '\1 \2', 'g'), '(\s)[~^`''"](\s)', '\1\2', 'g'), '(\s)[~^`''"](\s)', '\1\2', 'g'), '[ \t]+', ' ', 'g'), E' \n\t\r')"""


@query(f"SELECT result_id, {_TYPO} AS text FROM ocr_result")
def typography_norm(spark, folder):
    return read(spark, folder, "ocr_result").select("result_id", T.typography("full_text").alias("text"))


@query(
    r"""SELECT doc_id, length(text) AS n_chars_found, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n_words
    FROM documents WHERE text IS NOT NULL"""
)
def text_counts(spark, folder):
    d = read(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_chars_found"), T.word_count("text").cast("bigint").alias("n_words"))


@query(
    r"""WITH f AS (SELECT DISTINCT file_path AS path, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(file_path, '[^/]*$') AS name
        FROM ocr_result WHERE file_path IS NOT NULL),
    k AS (SELECT *, list_transform(regexp_extract_all(lower(name), '\d+|\D+'), lambda p: CASE WHEN regexp_full_match(p, '\d{1,30}') THEN lpad(ltrim(p, '0'), 30, '0') ELSE p END) AS parts FROM f)
    SELECT path, name, CAST(row_number() OVER (PARTITION BY folder ORDER BY CASE WHEN regexp_matches(name, '^\d') THEN list_prepend('', parts) ELSE parts END, name) AS INTEGER) AS ordinal FROM k"""
)
def natural_sort(spark, folder):
    files = read(spark, folder, "ocr_result").where("file_path is not null").select(F.col("file_path").alias("path")).distinct()
    return pages.ordinals(files).select("path", "name", "ordinal")


@query(
    r"""SELECT line_id, t.pos AS pos, regexp_extract(tok, '^[(\[{"'']*') AS lead,
        regexp_extract(substr(tok, length(regexp_extract(tok, '^[(\[{"'']*')) + 1), '[.,;:!?)''"}\]]*$') AS tail
    FROM train, (SELECT unnest(range(1, 400)) AS pos) t, LATERAL (SELECT list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[t.pos] AS tok)
    WHERE tok IS NOT NULL"""
)
def affix_peel(spark, folder):
    toks = read(spark, folder, "train").select("line_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("pos", "tok"))
    return toks.select("line_id", (F.col("pos") + 1).cast("bigint").alias("pos"), T.peel("tok").alias("p")).select("line_id", "pos", "p.lead", "p.tail")


@query(
    """SELECT doc_id, CAST((length(text) - length(replace(lower(text), 'phiếu', ''))) / 5 AS BIGINT) AS n_found, CAST(instr(lower(text), 'phiếu') AS BIGINT) AS first_pos
    FROM documents WHERE contains(lower(text), 'phiếu')"""
)
def find_in_documents(spark, folder):
    return pages.find_text(read(spark, folder, "documents"), ["doc_id"], "text", "phiếu")


# --- entities and domains

_ENT = "|".join(p for _, p in entities.KINDS).replace("'", "''")


def _kind_sql(e: str) -> str:
    cases = " ".join(f"WHEN regexp_full_match({e}, '{p.removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b')}') THEN '{k}'" for k, p in entities.KINDS)
    return f"CASE {cases} ELSE 'other' END"


_ENT_ROWS = f"""(SELECT doc_id, lang, unnest(regexp_extract_all(text, '{_ENT}')) AS entity, generate_subscripts(regexp_extract_all(text, '{_ENT}'), 1) AS position FROM documents)"""


@query(f"SELECT doc_id, CAST(position AS INTEGER) AS position, entity, {_kind_sql('entity')} AS kind FROM {_ENT_ROWS}")
def entity_scan(spark, folder):
    return entities.entity_rows(read(spark, folder, "documents"), ["doc_id"])


@query(f"SELECT lang, {_kind_sql('entity')} AS kind, count(*) AS n_entities, count(DISTINCT doc_id) AS n_rows FROM {_ENT_ROWS} GROUP BY ALL")
def entity_kind_by_lang(spark, folder):
    return entities.entity_summary(read(spark, folder, "documents"), "lang", "doc_id")


@query(
    f"""SELECT doc_id, md5(array_to_string(list_transform(string_split_regex(text, '{_ENT}'), lambda p, i: CASE WHEN i = 1 THEN p ELSE '__SHIELD_ENT_' || CAST(i - 2 AS VARCHAR) || '__' || p END), '')) AS masked
    FROM documents WHERE text IS NOT NULL"""
)
def entity_mask(spark, folder):
    d = read(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", F.md5(entities.shield("text")["shielded"]).alias("masked"))


@query("SELECT count(*) AS n_rows, count(*) AS n_same FROM documents WHERE text IS NOT NULL")
def entity_roundtrip(spark, folder):
    d = read(spark, folder, "documents").where("text is not null").select("text", entities.shield("text").alias("s"))
    back = entities.unshield(F.col("s.shielded"), F.col("s.saved"))
    return d.agg(F.count("*").alias("n_rows"), F.count_if(back == F.col("text")).alias("n_same"))


def _score_sql(domain: str, text: str) -> str:
    hits = " + ".join(f"CAST(contains(lower({text}), '{k}') AS INTEGER)" for d, k, _ in domains.keyword_table() if d == domain)
    return f"round(({hits}) * CAST({domains.DOMAINS[domain][0]} AS DOUBLE), 4)"


_SCORES = " UNION ALL ".join(f"SELECT result_id, '{d}' AS domain, {_score_sql(d, 'full_text')} AS score FROM ocr_result WHERE full_text IS NOT NULL" for d in domains.DOMAINS)


@query(_SCORES)
def domain_scores(spark, folder):
    return domains.domain_scores(read(spark, folder, "ocr_result"), ["result_id"], "full_text")


@query(f"SELECT result_id, domain, score FROM ({_SCORES}) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY score DESC, domain) = 1")
def domain_top1(spark, folder):
    return domains.top_domain(read(spark, folder, "ocr_result"), ["result_id"], "full_text")


_WORDS = ", ".join(f"('{w}', '{d}')" for d, ws in domains.DOMAIN_WORDS.items() for w in ws)


@query(
    rf"""WITH t AS (SELECT DISTINCT result_id AS key, unnest(regexp_extract_all(lower(full_text), '[\p{{L}}\p{{M}}\p{{N}}]+')) AS word FROM ocr_result),
    m(word, domain) AS (VALUES {_WORDS}), s AS ({_SCORES})
    SELECT t.key, t.word, max(CASE WHEN score > 0 THEN 1 + least(score * 0.4, 2.5) ELSE 1 END) AS boost
    FROM t LEFT JOIN m USING (word) LEFT JOIN s ON s.result_id = t.key AND s.domain = m.domain GROUP BY ALL"""
)
def domain_boost(spark, folder):
    results = read(spark, folder, "ocr_result")
    words = lexicon.tokens(results.select(F.col("result_id").alias("key"), "full_text"), ["key"], "full_text").select("key", F.col("token").alias("word")).distinct()
    scores = domains.domain_scores(results, ["result_id"], "full_text").withColumnRenamed("result_id", "key")
    return domains.word_boost(words, scores, spark)


# --- lexicon and n-grams

_TOKS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}]+')"


@query(rf"SELECT word, count(*) AS n FROM (SELECT unnest({_TOKS.format('text')}) AS word FROM documents) WHERE regexp_full_match(word, '[\p{{L}}\p{{M}}]+') GROUP BY word")
def lexicon_build(spark, folder):
    return lexicon.lexicon(read(spark, folder, "documents"))


@query(
    rf"""SELECT {_FOLD.format('word')} AS unaccented, count(*) AS n_words, min(word) AS first_word
    FROM (SELECT DISTINCT unnest({_TOKS.format('text')}) AS word FROM documents) WHERE regexp_full_match(word, '[\p{{L}}\p{{M}}]+') GROUP BY 1"""
)
def lexicon_unaccented(spark, folder):
    grouped = lexicon.by_unaccented(lexicon.lexicon(read(spark, folder, "documents")))
    return grouped.select("unaccented", F.size("words").cast("bigint").alias("n_words"), F.element_at("words", 1).alias("first_word"))


def _gram_sql(n: int, table: str) -> str:
    cols = ", ".join(f"ws[i + {k}] AS w{k + 1}" for k in range(n))
    return f"""SELECT {", ".join(f"w{k + 1}" for k in range(n))}, count(*) AS cnt FROM (SELECT {cols} FROM (SELECT ws, unnest(range(1, len(ws) - {n - 2})) AS i
        FROM (SELECT {_TOKS.format('text')} AS ws FROM {table}) WHERE len(ws) >= {n})) GROUP BY ALL"""


@query(_gram_sql(2, "documents"))
def bigram_counts(spark, folder):
    return lexicon.ngrams(read(spark, folder, "documents"), [], 2)


@query(_gram_sql(3, "documents"))
def trigram_counts(spark, folder):
    return lexicon.ngrams(read(spark, folder, "documents"), [], 3)


def _stem_sql(t: str) -> str:
    u = _FOLD.format(t)
    forms = [t, u, f"replace({u}, 'd', 'đ')"]
    for wrong, right in lexicon.HOMOGLYPHS:
        forms += [f"CASE WHEN contains({u}, '{wrong}') THEN {r} END" for r in (f"replace({u}, '{wrong}', '{right}')", f"replace(replace({u}, '{wrong}', '{right}'), 'd', 'đ')")]
    return f"list_distinct([{', '.join(forms)}])"


@query(f"SELECT token, unnest({_stem_sql('token')}) AS stem FROM (SELECT DISTINCT unnest({_TOKS.format('text')}) AS token FROM train)")
def candidate_stems(spark, folder):
    toks = lexicon.tokens(read(spark, folder, "train"), []).select("token").distinct()
    return toks.select("token", F.explode(lexicon.candidate_stems(F.col("token"))).alias("stem"))


@query(
    f"""WITH t AS (SELECT token, unnest({_stem_sql('token')}) AS stem FROM (SELECT DISTINCT unnest({_TOKS.format('text')}) AS token FROM train)),
    l AS (SELECT DISTINCT unnest({_TOKS.format('text')}) AS word FROM documents), k AS (SELECT word FROM l WHERE regexp_full_match(word, '[\\p{{L}}\\p{{M}}]+'))
    SELECT token, word AS candidate FROM t JOIN k ON stem = word UNION SELECT token, word FROM t JOIN k ON stem = {_FOLD.format('word')}"""
)
def candidate_words(spark, folder):
    toks = lexicon.tokens(read(spark, folder, "train"), []).select("token").distinct()
    return lexicon.candidates(toks, lexicon.lexicon(read(spark, folder, "documents")))


@query(
    f"""WITH t AS (SELECT line_id, ws[i] AS token, i - 1 AS pos FROM (SELECT line_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT line_id, {_TOKS.format('text')} AS ws FROM train))),
    b AS ({_gram_sql(2, 'train')}), g AS ({_gram_sql(3, 'train')}),
    c AS (SELECT *, lag(token, 2) OVER w AS p2, lag(token) OVER w AS p1, lead(token) OVER w AS n1, lead(token, 2) OVER w AS n2 FROM t WINDOW w AS (PARTITION BY line_id ORDER BY pos))
    SELECT line_id, CAST(pos AS INTEGER) AS pos, token, round(1.5::DOUBLE * coalesce(b1.cnt, 0) + 1.2::DOUBLE * coalesce(b2.cnt, 0) + 2.5::DOUBLE * coalesce(g1.cnt, 0)
        + 3.0::DOUBLE * coalesce(g2.cnt, 0) + 2.0::DOUBLE * coalesce(g3.cnt, 0), 4) AS score
    FROM c LEFT JOIN b b1 ON b1.w1 = p1 AND b1.w2 = token LEFT JOIN b b2 ON b2.w1 = token AND b2.w2 = n1 LEFT JOIN g g1 ON g1.w1 = p2 AND g1.w2 = p1 AND g1.w3 = token
    LEFT JOIN g g2 ON g2.w1 = p1 AND g2.w2 = token AND g2.w3 = n1 LEFT JOIN g g3 ON g3.w1 = token AND g3.w2 = n1 AND g3.w3 = n2"""
)
def context_score(spark, folder):
    rows = read(spark, folder, "train")
    return lexicon.context_scores(lexicon.tokens(rows, ["line_id"]), "line_id", lexicon.ngrams(rows, [], 2), lexicon.ngrams(rows, [], 3))


@query(
    rf"""WITH l AS (SELECT word FROM (SELECT unnest({_TOKS.format('text')}) AS word FROM documents) WHERE regexp_full_match(word, '[\p{{L}}\p{{M}}]+') GROUP BY word HAVING count(*) >= 2),
    t AS (SELECT line_id, unnest({_TOKS.format('text')}) AS token FROM train),
    s AS (SELECT line_id, count(*) AS n_words, round(least(0.98, 0.70 + 0.25 * avg(CASE WHEN word IS NOT NULL OR regexp_matches(token, '[0-9]') THEN 1.0::DOUBLE ELSE 0.0 END)), 6) AS confidence
        FROM t LEFT JOIN l ON word = token GROUP BY line_id)
    SELECT line_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(confidence, 0.5) AS DOUBLE) AS confidence FROM train LEFT JOIN s USING (line_id)"""
)
def confidence(spark, folder):
    return lexicon.confidence(read(spark, folder, "train"), ["line_id"], lexicon.lexicon(read(spark, folder, "documents"), least=2))


# --- correction

@query()
def phrase_rewrite(spark, folder):
    return read(spark, folder, "train").select("line_id", decode.rewrite(F.col("text")).alias("text"))


@query()
def text_correct(spark, folder):
    """The whole correction over the lines of train that lost accents or not, with tables counted from train."""
    rows = read(spark, folder, "train")
    model = decode.load_model(lexicon.lexicon(rows, least=3), lexicon.ngrams(rows, [], 2).where("cnt >= 2"), lexicon.ngrams(rows, [], 3).where("cnt >= 2"))
    return decode.correct(rows, ["line_id"], model)


@query()
def province_snap(spark, folder):
    names = decode.place_names(read(spark, folder, "ref_value").where("field_name = 'tinh_thanh'").orderBy("ref_id").select("canonical"))
    values = read(spark, folder, "ocr_result").select(F.col("extracted_fields")["tinh_thanh"].alias("v"))
    return decode.snap_places(values, "v", names)


_CONF = "round((('0x' || substr(md5({0}), 1, 4))::INTEGER)::DOUBLE / 65536, 4)"
_P = f"trim({_FOLD.format('text')})"


def _acc(t: str) -> str:
    return f"(length({t}) - length(translate({t}, '{A.ACCENTS}', '')))"


_PCT = _CONF.format("'p' || line_id")
_VCT = _CONF.format("'v' || line_id")


@query(
    rf"""WITH i AS (SELECT line_id, CASE WHEN line_id % 3 = 0 THEN replace(p0, 'o', '0') ELSE p0 END AS p, v, pc, vc FROM
        (SELECT line_id, coalesce({_P}, '') AS p0, coalesce(trim(text), '') AS v, {_PCT} AS pc, {_VCT} AS vc FROM train)),
    j AS (SELECT *, {_acc('p')} AS pa, {_acc('v')} AS va FROM i),
    r AS (SELECT line_id, CASE WHEN p = '' AND v = '' THEN {{'t': '', 'c': 0.0::DOUBLE, 'w': 'none'}}
        WHEN p = '' THEN {{'t': v, 'c': vc, 'w': 'vietocr'}} WHEN v = '' THEN {{'t': p, 'c': pc, 'w': 'paddleocr'}}
        WHEN lower({_FOLD.format('p')}) = lower({_FOLD.format('v')}) THEN {{'t': v, 'c': greatest(vc, pc, 0.98), 'w': 'cross_verified'}}
        WHEN regexp_matches(v, '{A._CURRENCY}') AND NOT regexp_matches(p, '{A._CURRENCY}') THEN {{'t': v, 'c': greatest(vc, 0.96), 'w': 'vietocr'}}
        WHEN regexp_matches(v, '{A._LABEL}') AND va > pa THEN {{'t': v, 'c': greatest(vc, 0.95), 'w': 'vietocr'}}
        WHEN regexp_matches(p, '{A._CODE}') AND va = 0 AND pc >= 0.65 THEN {{'t': p, 'c': greatest(pc, 0.95), 'w': 'paddleocr'}}
        WHEN va > pa AND va >= 1 THEN {{'t': v, 'c': greatest(vc, 0.94), 'w': 'vietocr'}}
        WHEN pc > 0.92 AND vc < 0.70 THEN {{'t': p, 'c': pc, 'w': 'paddleocr'}} ELSE {{'t': v, 'c': greatest(vc, pc), 'w': 'vietocr'}} END AS a FROM j)
    SELECT line_id, a.t AS text, round(a.c, 6) AS conf, a.w AS winner FROM r"""
)
def arbitrate(spark, folder):
    conf = lambda p: F.round(F.conv(F.substring(F.md5(F.concat(F.lit(p), F.col("line_id").cast("string"))), 1, 4), 16, 10).cast("double") / 65536, 4)
    plain = F.trim(T.remove_accents("text"))
    paddle = F.when(F.col("line_id") % 3 == 0, F.replace(plain, F.lit("o"), F.lit("0"))).otherwise(plain)
    return read(spark, folder, "train").select("line_id", A.arbitrate(paddle, conf("p"), F.col("text"), conf("v")).alias("a")).select("line_id", "a.*")


# --- layout and geometry

_EXT = "e AS (SELECT page_id, count(*) AS n, max(img_w) AS img_w, greatest(0.0, min(x)) AS l, least(max(img_w)::DOUBLE, max(x + w)) AS r FROM ocr_box GROUP BY page_id)"
_HIST = f"""{_EXT}, h AS (SELECT page_id, unnest(range(a, b + 1)) AS bin FROM (SELECT page_id, greatest(0, CAST(trunc((x - l) / ((r - l) / 100)) AS INTEGER)) AS a,
    least(99, CAST(trunc((x + w - l) / ((r - l) / 100)) AS INTEGER)) AS b FROM ocr_box JOIN e USING (page_id) WHERE n >= 4 AND r > l) WHERE a <= b),
    d AS (SELECT page_id, CAST(bin AS INTEGER) AS bin, count(*) AS density FROM h GROUP BY ALL)"""


@query(f"WITH {_HIST} SELECT page_id, bin, density FROM d")
def box_projection(spark, folder):
    return layout.projection(read(spark, folder, "ocr_box"))


_GUT = f"""{_HIST}, m AS (SELECT page_id, sum(density) / 100 AS mean FROM d GROUP BY page_id),
    z AS (SELECT page_id, l, r, greatest(0.5, 0.08 * mean) AS most, unnest(range(15, 85)) AS bin FROM e JOIN m USING (page_id) WHERE n >= 4 AND img_w >= 100 AND r - l >= 0.4 * img_w),
    q AS (SELECT z.page_id, l, r, z.bin, z.bin - row_number() OVER (PARTITION BY z.page_id ORDER BY z.bin) AS island FROM z LEFT JOIN d ON d.page_id = z.page_id AND d.bin = z.bin
        WHERE coalesce(density, 0) <= most),
    v AS (SELECT page_id, min(l) AS l, min(r) AS r, min(bin) AS s, max(bin) + 1 AS t FROM q GROUP BY page_id, island HAVING count(*) >= 3),
    g AS (SELECT page_id, s, t, l + (s + t) / 2.0 * (r - l) / 100 AS gx FROM v QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY t - s DESC, s) = 1)"""


@query(f"WITH {_GUT} SELECT page_id, CAST(s AS INTEGER) AS start_bin, CAST(t AS INTEGER) AS end_bin, round(gx, 4) AS gutter_x FROM g")
def columns_gutter(spark, folder):
    return layout.gutters(read(spark, folder, "ocr_box")).withColumn("gutter_x", F.round("gutter_x", 4))


@query(
    f"""WITH {_GUT}, b AS (SELECT o.page_id, box_id, y, h, CASE WHEN x + w / 2.0 < gx THEN 0 WHEN gx IS NOT NULL THEN 1 END AS side FROM ocr_box o LEFT JOIN g USING (page_id)),
    c AS (SELECT page_id FROM (SELECT page_id, side FROM b WHERE side IS NOT NULL GROUP BY page_id, side HAVING count(*) >= 2 AND max(y + h) - min(y) >= 50) GROUP BY page_id HAVING count(*) = 2)
    SELECT b.page_id, box_id, CASE WHEN c.page_id IS NULL THEN 0 ELSE side END AS col_id FROM b LEFT JOIN c USING (page_id)"""
)
def columns_detect(spark, folder):
    return layout.columns(read(spark, folder, "ocr_box")).select("page_id", "box_id", "col_id")


@query()
def reading_order(spark, folder):
    return layout.lines(read(spark, folder, "ocr_box"))


@query()
def page_text(spark, folder):
    return layout.page_text(read(spark, folder, "ocr_box"))


@query(
    """SELECT box_key, list_min(list_transform(polygon, lambda p: p.x)) AS px, list_min(list_transform(polygon, lambda p: p.y)) AS py,
        round(list_max(list_transform(polygon, lambda p: p.x)) - list_min(list_transform(polygon, lambda p: p.x)), 6) AS pw,
        round(list_max(list_transform(polygon, lambda p: p.y)) - list_min(list_transform(polygon, lambda p: p.y)), 6) AS ph
    FROM ocr_box WHERE len(polygon) > 0"""
)
def polygon_bounds(spark, folder):
    b = read(spark, folder, "ocr_box").where("size(polygon) > 0").select("box_key", layout.bounding_box(F.col("polygon")).alias("b"))
    return b.select("box_key", F.col("b.x").alias("px"), F.col("b.y").alias("py"), F.round("b.w", 6).alias("pw"), F.round("b.h", 6).alias("ph"))


@query(
    """SELECT box_key, CAST(greatest(4, floor(h * 0.16)) AS BIGINT) AS pad_y, CAST(greatest(4, floor(h * 0.08)) AS BIGINT) AS pad_x,
        CASE WHEN least(img_w, img_h) < 1400 THEN round(least(2.0, 1600.0::DOUBLE / least(img_w, img_h)), 6) ELSE 1.0 END::DOUBLE AS scale,
        coalesce(len(polygon) = 4 AND w >= 5 AND h >= 5, false) AS usable
    FROM ocr_box"""
)
def crop_padding(spark, folder):
    b = read(spark, folder, "ocr_box")
    return b.select(
        "box_key", G.crop_padding(F.col("h")).alias("p"), F.round(G.detection_scale(F.col("img_w"), F.col("img_h")), 6).alias("scale"),
        F.coalesce(G.enough_polygon(F.col("polygon"), F.col("w"), F.col("h")), F.lit(False)).alias("usable"),
    ).select("box_key", "p.*", "scale", "usable")


_MODE = "CASE page_id % 3 WHEN 0 THEN 'fit_image' WHEN 1 THEN 'a4_portrait' ELSE 'a4_landscape' END"
_PAGE = f"""(SELECT *, CASE WHEN mode = 'fit_image' THEN img_w * 72.0::DOUBLE / 300 ELSE img_w * sc END AS sw, CASE WHEN mode = 'fit_image' THEN img_h * 72.0::DOUBLE / 300 ELSE img_h * sc END AS sh FROM
    (SELECT *, least((pw - 40) / img_w, (ph - 40) / img_h) AS sc FROM
    (SELECT *, CASE mode WHEN 'fit_image' THEN img_w * 72.0::DOUBLE / 300 WHEN 'a4_landscape' THEN 841.89::DOUBLE ELSE 595.28::DOUBLE END AS pw,
        CASE mode WHEN 'fit_image' THEN img_h * 72.0::DOUBLE / 300 WHEN 'a4_landscape' THEN 595.28::DOUBLE ELSE 841.89::DOUBLE END AS ph FROM
    (SELECT *, {_MODE} AS mode FROM ocr_box))))"""


@query(
    f"""SELECT DISTINCT page_id, round(pw, 4) AS page_w, round(ph, 4) AS page_h, round((pw - sw) / 2, 4) AS x, round((ph - sh) / 2, 4) AS y, round(sw, 4) AS shown_w, round(sh, 4) AS shown_h FROM {_PAGE}"""
)
def pdf_page_geometry(spark, folder):
    b = read(spark, folder, "ocr_box").select("page_id", "img_w", "img_h", F.expr(_MODE).alias("mode")).distinct()
    return b.select("page_id", G.page_geometry(F.col("img_w"), F.col("img_h"), F.col("mode"), F.lit(300.0)).alias("g")).select("page_id", "g.*")


@query(
    f"""SELECT box_key, round(x0 + x * sx, 3) AS x, round(y0 + (y + 0.82 * h) * sy, 3) AS baseline, round(w * sx, 3) AS w, round(least(36.0, greatest(4.0, 0.78 * h * sy)), 3) AS font_size
    FROM (SELECT *, round((pw - sw) / 2, 4) AS x0, round((ph - sh) / 2, 4) AS y0, round(sw, 4) / img_w AS sx, round(sh, 4) / img_h AS sy FROM {_PAGE}) WHERE trim(text) <> ''"""
)
def pdf_text_layer(spark, folder):
    b = read(spark, folder, "ocr_box").where("trim(text) <> ''").withColumn("mode", F.expr(_MODE))
    g = G.page_geometry(F.col("img_w"), F.col("img_h"), F.col("mode"), F.lit(300.0))
    c = F.col
    return b.withColumn("g", g).select("box_key", G.text_position(c("x"), c("y"), c("w"), c("h"), c("img_w"), c("img_h"), c("g")).alias("t")).select("box_key", "t.*")


_LINES = "(SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_discount * 100 AS y1, l_tax * 100 AS x2, l_linenumber * 3.0 AS y2, l_linenumber::DOUBLE AS x3, l_quantity / 2 AS y3, 7.0 AS x4, l_discount * 50 AS y4 FROM lineitem)"


@query(
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN abs(det) >= 1e-6 THEN round((b1 * c2 - b2 * c1) / det, 4) END AS ix, CASE WHEN abs(det) >= 1e-6 THEN round((a2 * c1 - a1 * c2) / det, 4) END AS iy
    FROM (SELECT *, a1 * b2 - a2 * b1 AS det FROM (SELECT l_orderkey, l_linenumber, y2 - y1 AS a1, x1 - x2 AS b1, x2 * y1 - x1 * y2 AS c1, y4 - y3 AS a2, x3 - x4 AS b2, x4 * y3 - x3 * y4 AS c2 FROM {_LINES}))"""
)
def line_intersection(spark, folder):
    c = F.col
    li = read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", c("l_quantity").alias("x1"), (c("l_discount") * 100).alias("y1"), (c("l_tax") * 100).alias("x2"), (c("l_linenumber") * F.lit(3.0)).alias("y2"),
        c("l_linenumber").cast("double").alias("x3"), (c("l_quantity") / 2).alias("y3"), F.lit(7.0).alias("x4"), (c("l_discount") * 50).alias("y4"),
    )
    m, n = G.line_of(G.point(c("x1"), c("y1")), G.point(c("x2"), c("y2"))), G.line_of(G.point(c("x3"), c("y3")), G.point(c("x4"), c("y4")))
    return li.select("l_orderkey", "l_linenumber", G.intersection(m, n).alias("i")).select("l_orderkey", "l_linenumber", F.round("i.x", 4).alias("ix"), F.round("i.y", 4).alias("iy"))


_CORNER = """(list_transform(range(1, 5), lambda i: {{'k': {0}, 'i': i, 'x': polygon[i].x, 'y': polygon[i].y}}))"""
_BEST = lambda key: f"list_sort({_CORNER.format(key)})[1]"
_DIST = "sqrt(power({0}.x - {1}.x, 2) + power({0}.y - {1}.y, 2))"
_ANGLE = "degrees(atan2({1}.y - {0}.y, {1}.x - {0}.x))"
_TURN = lambda a, b: f"least(abs({a} - {b}) % 180.0, 180.0 - abs({a} - {b}) % 180.0)"
_SHOELACE = lambda p: "abs(" + " + ".join(f"({p[k]}.x * {p[(k + 1) % 4]}.y - {p[(k + 1) % 4]}.x * {p[k]}.y)" for k in range(4)) + ") / 2"
_Q = ("tl", "tr", "br", "bl")


@query(
    f"""WITH c AS (SELECT box_key, img_w, img_h, {_SHOELACE([f"polygon[{k}]" for k in range(1, 5)])} AS a0,
        {_BEST("polygon[i].x + polygon[i].y")} AS tl, {_BEST("polygon[i].y - polygon[i].x")} AS tr, {_BEST("-(polygon[i].x + polygon[i].y)")} AS br, {_BEST("polygon[i].x - polygon[i].y")} AS bl
        FROM ocr_box WHERE len(polygon) = 4),
    o AS (SELECT *, {_SHOELACE(_Q)} AS area4, {" AND ".join(f"{_DIST.format(_Q[a], _Q[b])} >= 15" for a in range(4) for b in range(a + 1, 4))} AND {_SHOELACE(_Q)} >= 100 AS ordered,
        ({_DIST.format("tl", "tr")} + {_DIST.format("bl", "br")}) / 2 AS across, ({_DIST.format("tl", "bl")} + {_DIST.format("tr", "br")}) / 2 AS down FROM c)
    SELECT box_key, round(a0, 3) AS area, ordered, ordered AND down > 0 AND across >= 0.35 * img_w AND down >= 0.35 * img_h AND across / nullif(down, 0) BETWEEN 0.35 AND 2.8
        AND {_TURN(_ANGLE.format("tl", "tr"), _ANGLE.format("bl", "br"))} <= 14 AND {_TURN(_ANGLE.format("tl", "bl"), _ANGLE.format("tr", "br"))} <= 14 AND area4 >= 0.2 * img_w * img_h AS document FROM o"""
)
def quad_valid(spark, folder):
    """Corners of the boxes' polygons in order, whether they can be a document, and their area."""
    b = read(spark, folder, "ocr_box").where("size(polygon) = 4").select("box_key", "img_w", "img_h", G.order_points(F.col("polygon")).alias("q"), F.round(G.area(F.col("polygon")), 3).alias("area"))
    return b.select("box_key", "area", F.col("q").isNotNull().alias("ordered"), F.coalesce(G.is_document(F.col("q"), F.col("img_w"), F.col("img_h")), F.lit(False)).alias("document"))


@query(
    """SELECT k AS event_type, round(CASE WHEN abs(m) < 0.55 THEN 0.0 ELSE m END, 6) AS skew
    FROM (SELECT event_type AS k, quantile_cont((value - 50) / 5, 0.5) AS m FROM events WHERE value IS NOT NULL GROUP BY event_type HAVING count(*) >= 4)"""
)
def skew_median(spark, folder):
    return stats.median_angle(read(spark, folder, "events").select("event_type", ((F.col("value") - 50) / 5).alias("a")), "event_type", "a")


@query(
    """WITH r AS (SELECT event_type AS k, (value - 50) / 5 AS a, 1 + event_id % 7 AS w FROM events WHERE value IS NOT NULL),
    q AS (SELECT k, quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.75) AS q3 FROM r GROUP BY k HAVING count(*) >= 6),
    f AS (SELECT r.* FROM r JOIN q USING (k) WHERE a BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5),
    s AS (SELECT k, a, sum(w) OVER (PARTITION BY k ORDER BY a RANGE UNBOUNDED PRECEDING) AS u, sum(w) OVER (PARTITION BY k) AS t FROM f),
    m AS (SELECT k, min(a) AS m FROM s WHERE u >= t / 2 GROUP BY k)
    SELECT k AS event_type, round(CASE WHEN abs(m) < 0.55 THEN 0.0 ELSE m END, 6) AS skew FROM m"""
)
def skew_weighted_median(spark, folder):
    rows = read(spark, folder, "events").where("value is not null").select("event_type", ((F.col("value") - 50) / 5).alias("a"), (1 + F.col("event_id") % 7).alias("w"))
    return stats.weighted_median_angle(rows, "event_type", "a", "w")


@query(
    """SELECT event_type, event_id, max(value) OVER u AS best_accuracy, min(loss) OVER u AS least_loss,
        (max(value) OVER b IS NULL OR value >= max(value) OVER b OR loss < min(loss) OVER b) AS is_best
    FROM (SELECT event_type, event_id, value, abs(value - 40) AS loss FROM events WHERE value IS NOT NULL)
    WINDOW u AS (PARTITION BY event_type ORDER BY event_id), b AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def best_so_far(spark, folder):
    log = read(spark, folder, "events").where("value is not null").select("event_type", "event_id", "value", F.abs(F.col("value") - 40).alias("loss"))
    return stats.best_so_far(log, "event_type", "event_id", "value", "loss").select("event_type", "event_id", "best_accuracy", "least_loss", "is_best")


# --- pages

@query(
    """SELECT file_path, page_index, result_id, char_count FROM ocr_result
    QUALIFY row_number() OVER (PARTITION BY file_path, page_index ORDER BY result_id DESC) = 1"""
)
def latest_request_wins(spark, folder):
    return pages.latest(read(spark, folder, "ocr_result").select("file_path", "page_index", "result_id", "char_count"), ["file_path", "page_index"], "result_id")


@query(
    r"""SELECT file_path, page_index, total_pages, CASE WHEN total_pages > 1 THEN name || ' (Trang ' || (page_index + 1) || '/' || total_pages || ')' ELSE name END AS label,
        regexp_replace(name, '\.[^.]*$', '') || '_p' || lpad(CAST(page_index + 1 AS VARCHAR), 4, '0') || '_highres.pdf' AS output_name
    FROM (SELECT *, count(*) OVER (PARTITION BY file_path) AS total_pages, regexp_extract(file_path, '[^/]*$') AS name
        FROM (SELECT DISTINCT file_path, page_index FROM ocr_result WHERE file_path IS NOT NULL AND page_index IS NOT NULL))"""
)
def page_labels(spark, folder):
    return pages.page_labels(read(spark, folder, "ocr_result"))


@query(
    """SELECT result_id, ((page_index * 90 - 270) % 360 + 360) % 360 AS rotation, CASE WHEN o = 3 THEN 7 WHEN o > 3 AND o <= 7 THEN o - 1 ELSE o END AS ordinal
    FROM (SELECT result_id, page_index, page_index + 1 AS o FROM ocr_result)"""
)
def page_moves(spark, folder):
    p = read(spark, folder, "ocr_result").select("result_id", pages.rotated(F.col("page_index") * 90, F.lit(-270)).alias("rotation"), (F.col("page_index") + 1).alias("ordinal"))
    return pages.moved(p, "ordinal", 3, 7)


@query(
    """SELECT r.file_path, r.page_index, r.result_id, c.full_text IS NULL AS needs_run FROM ocr_result r
    LEFT JOIN (SELECT file_path, page_index, max(full_text) AS full_text FROM ocr_result WHERE error IS NULL GROUP BY ALL) c ON r.file_path = c.file_path AND r.page_index = c.page_index"""
)
def cached_results(spark, folder):
    r = read(spark, folder, "ocr_result")
    return pages.with_cached(r.select("file_path", "page_index", "result_id"), r.where("error is null"), ["file_path", "page_index"], "full_text").select("file_path", "page_index", "result_id", "needs_run")


# --- data sets

_H = "md5('42:' || sample_id)"


@query(f"SELECT sample_id, CASE WHEN ('0x' || substr({_H}, 1, 8))::BIGINT::DOUBLE / 4294967296 < 0.15 THEN 'val' ELSE 'train' END AS split FROM train_annotation")
def dataset_split(spark, folder):
    return D.split(read(spark, folder, "train_annotation").drop("split"), "sample_id").select("sample_id", "split")


@query(
    f"""SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY {_H}, sample_id) <= least(count(*) OVER (), greatest(10, CAST(floor(count(*) OVER () * 0.15) AS BIGINT))) THEN 'val' ELSE 'train' END AS split
    FROM (SELECT DISTINCT sample_id FROM train_annotation WHERE sample_id IS NOT NULL)"""
)
def dataset_split_exact(spark, folder):
    return D.split_exact(read(spark, folder, "train_annotation"), "sample_id")


@query("SELECT sample_id, source, CAST(c AS INTEGER) AS copy_no FROM train_annotation, LATERAL (SELECT unnest(range(CASE WHEN source = 'handwriting' THEN 2 ELSE 1 END)) AS c)")
def oversample(spark, folder):
    t = read(spark, folder, "train_annotation").select("sample_id", "source")
    return D.oversample(t, F.when(F.col("source") == "handwriting", 2).otherwise(1))


@query(
    r"""SELECT source, count(*) AS n, count(*) FILTER (WHERE length(trim(nfc_normalize(label))) >= 2 AND regexp_matches(trim(nfc_normalize(label)), '[\p{L}\p{N}]')) AS good_text,
        count(*) FILTER (WHERE contains(lower(regexp_extract(img_path, '[^/\\]*$')), ' - copy')) AS copies,
        count(*) FILTER (WHERE 3 + sample_id % 14 >= 8 AND 4 + sample_id % 11 >= 8 AND length(label) <= 120) AS usable FROM train_annotation GROUP BY source"""
)
def quality_gate(spark, folder):
    t = read(spark, folder, "train_annotation")
    return t.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(D.text_gate(F.col("label"))).alias("good_text"), F.count_if(D.is_copy(F.col("img_path"))).alias("copies"),
        F.count_if(D.sample_gate(3 + F.col("sample_id") % 14, 4 + F.col("sample_id") % 11, F.col("label"))).alias("usable"),
    )


@query("SELECT count(*) AS n, count(*) FILTER (WHERE h >= 10 AND w >= 12) AS large_enough FROM ocr_box")
def crop_gate(spark, folder):
    return read(spark, folder, "ocr_box").agg(F.count("*").alias("n"), F.count_if(D.crop_gate(F.col("h"), F.col("w"))).alias("large_enough"))


@query(r"SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM train) WHERE NOT regexp_matches(ch, '^\s$') GROUP BY ch")
def char_dictionary(spark, folder):
    return D.char_dictionary(read(spark, folder, "train"), "text")


@query(
    """SELECT box_key, 'crop_' || CASE WHEN n > 999999 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 6, '0') END || '.jpg' AS crop_name
    FROM (SELECT box_key, row_number() OVER (ORDER BY file_path NULLS FIRST, page_id NULLS FIRST, y NULLS FIRST, x NULLS FIRST, box_key) AS n FROM ocr_box)"""
)
def crop_names(spark, folder):
    boxes = read(spark, folder, "ocr_box").select("box_key", "file_path", "page_id", "y", "x")
    return D.crop_names(boxes, ["file_path", "page_id", "y", "x", "box_key"]).select("box_key", "crop_name")


def _phrase_sql(text: str, phrases: tuple[str, ...], fold_case: bool = True) -> str:
    """The phrases put in by RE2, which knows no lookaround: what stands around a phrase is kept, and a second pass finds neighbours."""
    out = f"trim(nfc_normalize({text}))"
    word = "[^\\p{L}\\p{M}\\p{N}_]"
    for pattern, phrase in decode.phrase_rules(phrases):
        body = pattern.removeprefix(D.BOUND).removesuffix(D.BOUND)
        for _ in range(2):
            out = f"regexp_replace({out}, '(?i)(^|{word}){body}($|{word})', '\\1{phrase}\\2', 'g')"
    return f"trim({out})"


_CLEAN = _phrase_sql("label", D.LABEL_PHRASES)


@query(f"SELECT sample_id, {_CLEAN} AS label FROM train_annotation")
def label_clean(spark, folder):
    return read(spark, folder, "train_annotation").select("sample_id", D.clean_label(F.col("label")).alias("label"))


@query(f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_CLEAN} IS DISTINCT FROM label) AS n_changed FROM train_annotation")
def label_clean_count(spark, folder):
    return D.changed_labels(read(spark, folder, "train_annotation"), "label")


@query(f"SELECT sample_id FROM (SELECT sample_id FROM train_annotation ORDER BY md5('42:' || sample_id), sample_id LIMIT 100)")
def first_documents(spark, folder):
    return D.first_documents(read(spark, folder, "train_annotation").select("sample_id"), "sample_id", 100)


@query("SELECT box_key FROM ocr_box WHERE length(trim(text)) > 0 AND file_path IN (SELECT file_path FROM ocr_result WHERE error IS NULL)")
def labels_with_files(spark, folder):
    labels = read(spark, folder, "ocr_box").select("box_key", F.col("file_path").alias("path"), F.col("text").alias("label"))
    files = read(spark, folder, "ocr_result").where("error is null").select(F.col("file_path").alias("path"))
    return D.with_files(labels, files).select("box_key")


@query("SELECT 'train' AS origin, line_id AS id, text AS label FROM train UNION ALL SELECT 'annotation', sample_id, label FROM train_annotation")
def labels_union(spark, folder):
    a = read(spark, folder, "train").select(F.lit("train").alias("origin"), F.col("line_id").alias("id"), F.col("text").alias("label"))
    return a.unionByName(read(spark, folder, "train_annotation").select(F.lit("annotation").alias("origin"), F.col("sample_id").alias("id"), "label"))


# --- rasters: the 64 numbers of an embedding as an image of 8 x 8

def _images(spark: SparkSession, folder: str) -> DataFrame:
    px = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.round((v.cast("double") + 1) * 127.5).cast("int"))))
    hexed = F.array_join(F.transform(px, lambda p: F.lpad(F.hex(p), 2, "0")), "")
    return read(spark, folder, "embeddings").select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), F.unhex(hexed).alias("data"))


_PX = "list_transform(embedding, lambda v: least(255, greatest(0, round((v::DOUBLE + 1) * 127.5)::INTEGER)))"
_HEX = "list_transform({0}, lambda p: lower(lpad(to_hex(p), 2, '0')))"


def _hexed(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "width", "height", F.lower(F.hex("data")).alias("pixels"))


@query(f"SELECT vec_id, 8 AS width, 8 AS height, array_to_string(list_reverse({_HEX.format(_PX)}), '') AS pixels FROM embeddings")
def raster_rotate180(spark, folder):
    return _hexed(raster.apply(_images(spark, folder), ["vec_id"], lambda x: raster.rotate(x, 180)))


@query()
def raster_enhance(spark, folder):
    return _hexed(raster.apply(_images(spark, folder), ["vec_id"], lambda x: raster.enhance(x, raster.PRESETS["crisp_bw"])))


@query(f"SELECT vec_id, 64 AS n, round(list_avg(p), 6) AS mean, round(list_avg(list_transform(p, lambda v: v * v)) - list_avg(p) * list_avg(p), 6) AS variance FROM (SELECT vec_id, {_PX} AS p FROM embeddings)")
def raster_stats(spark, folder):
    px = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.round((v.cast("double") + 1) * 127.5).cast("int"))))
    stats_ = raster.pixel_stats(read(spark, folder, "embeddings").select("vec_id", px.alias("px")), ["vec_id"], "px")
    return stats_.select("vec_id", "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


def _kernel(spark, folder, kernel) -> DataFrame:
    return _hexed(raster.apply(_images(spark, folder), ["vec_id"], kernel))


def _pixel_sql(width: int, height: int, value: str, source: str = "(SELECT vec_id, {0} AS p FROM embeddings)") -> str:
    """An image of a size whose pixel (x, y) is an expression of the pixels p (64 of them, from 1) of the 8 x 8 image."""
    at = f"list_transform(range(0, {width * height}), lambda i: lower(lpad(to_hex(CAST({value.replace('{x}', f'(i % {width})').replace('{y}', f'(i // {width})')} AS INTEGER)), 2, '0')))"
    return f"SELECT vec_id, {width} AS width, {height} AS height, array_to_string({at}, '') AS pixels FROM {source.format(_PX)}"


@query(_pixel_sql(8, 8, "p[(7 - {x}) * 8 + {y} + 1]"))
def raster_rotate90(spark, folder):
    return _kernel(spark, folder, lambda x: raster.rotate(x, 90))


@query(_pixel_sql(8, 8, "p[{x} * 8 + 7 - {y} + 1]"))
def raster_rotate270(spark, folder):
    return _kernel(spark, folder, lambda x: raster.rotate(x, -90))


_BLOCK = "round_even((p[16 * {y} + 2 * {x} + 1] + p[16 * {y} + 2 * {x} + 2] + p[16 * {y} + 2 * {x} + 9] + p[16 * {y} + 2 * {x} + 10]) / 4.0, 0)"


@query(_pixel_sql(4, 4, _BLOCK))
def raster_shrink(spark, folder):
    """The longest side brought to 4 by the means of areas."""
    return _kernel(spark, folder, lambda x: raster.shrink(x, 4))


@query(_pixel_sql(4, 4, _BLOCK))
def raster_thumbnail(spark, folder):
    return _kernel(spark, folder, lambda x: raster.thumbnail(x, 4, 6))


@query(_pixel_sql(5, 6, "p[{y} * 8 + {x} + 1 + 1]"))
def raster_crop(spark, folder):
    """The box (2, 1, 3, 4) with a padding of one pixel."""
    return _kernel(spark, folder, lambda x: raster.crop(x, 2, 1, 3, 4, 1, 1))


# Sums over a window of an image whose edges are repeated, for the kernels that need them.
_IN = lambda v: f"greatest(0, least(7, {v}))"


def _window_sql(radius: int, weight: str = "1.0") -> str:
    """(vec_id, p, m): m[i] the weighted mean over the window of (2 radius + 1) squared pixels around pixel i; weight is an expression of d."""
    norm = f"list_sum(list_transform(range({-radius}, {radius + 1}), lambda d: {weight}))"
    row = f"list_transform(range(0, 64), lambda i: list_sum(list_transform(range({-radius}, {radius + 1}), lambda d: p[(i // 8) * 8 + {_IN('i % 8 + d')} + 1] * {weight})) / {norm})"
    col = f"list_transform(range(0, 64), lambda i: list_sum(list_transform(range({-radius}, {radius + 1}), lambda d: r[{_IN('i // 8 + d')} * 8 + i % 8 + 1] * {weight})) / {norm})"
    return f"(SELECT vec_id, p, {col} AS m FROM (SELECT vec_id, p, {row} AS r FROM (SELECT vec_id, {_PX} AS p FROM embeddings)))"


_BYTE = "round_even(greatest(0, least(255, {0})), 0)"
_FLAT = "least(255, p[i + 1] / greatest(m[i + 1], 1) * 255)"


@query(_pixel_sql(8, 8, _BYTE.format("1.45 * p[i + 1] - 0.45 * m[i + 1]"), _window_sql(4, "exp(-(d * d) / 2.88)")))
def raster_sharpen(spark, folder):
    return _kernel(spark, folder, lambda x: raster.sharpen(x, 0.6))


@query(_pixel_sql(8, 8, _BYTE.format("1.25 * p[i + 1] - 0.25 * m[i + 1]"), _window_sql(3, "exp(-(d * d) / 2.0)")))
def raster_enhance_crop(spark, folder):
    return _kernel(spark, folder, raster.enhance_crop)


@query(_pixel_sql(8, 8, _BYTE.format(f"255 * power(greatest(0, least(255, ({_FLAT} - 60) * 255 / 165)) / 255, 1.3)"), _window_sql(7)))
def raster_clean_bw(spark, folder):
    return _kernel(spark, folder, raster.clean_bw)


_NEW = f"(p[i + 1] * 0.5 + {_FLAT} * 0.5)"


@query(_pixel_sql(8, 8, _BYTE.format(f"CASE WHEN {_NEW} >= 232.5 THEN 255 ELSE 232.5 * power({_NEW} / 232.5, 1.15) END"), _window_sql(7)))
def raster_whiten(spark, folder):
    return _kernel(spark, folder, lambda x: raster.whiten(x, 0.5))


@query(_pixel_sql(8, 8, "CASE WHEN p[i + 1] > round_even(m[i + 1], 0) - 11 THEN 255 ELSE 0 END", _window_sql(10, "exp(-(d * d) / (2 * 3.5 * 3.5))")))
def raster_threshold(spark, folder):
    return _kernel(spark, folder, raster.adaptive_threshold)


@query(f"SELECT vec_id, least(p[1], p[8], p[57], p[64]) >= 120 AS full_page FROM (SELECT vec_id, {_PX} AS p FROM embeddings)")
def raster_full_page(spark, folder):
    flags = raster.apply(_images(spark, folder), ["vec_id"], lambda x: np.full((1, 1), 255 * raster.is_full_page(x), np.uint8))
    return flags.select("vec_id", (F.hex("data") == "FF").alias("full_page"))


@query(
    f"""SELECT vec_id, CAST(floor(median(v)) AS INTEGER) AS border FROM (SELECT vec_id, unnest(list_transform(range(0, 100), lambda k: p[((k // 5) % 5 + (k // 25) // 2 * 3) * 8 + k % 5 + (k // 25) % 2 * 3 + 1])) AS v
        FROM (SELECT vec_id, {_PX} AS p FROM embeddings)) GROUP BY vec_id"""
)
def raster_border(spark, folder):
    """Median of the four corners of five pixels."""
    out = raster.apply(_images(spark, folder), ["vec_id"], lambda x: np.full((1, 1), np.floor(raster.border_color(x)), np.uint8))
    return out.select("vec_id", F.conv(F.hex("data"), 16, 10).cast("int").alias("border"))


@query(
    """SELECT vec_id, t AS full_text, 2::BIGINT AS n_boxes, CAST(length(t) AS INTEGER) AS char_count, 2 AS word_count, 0.75::DOUBLE AS confidence, CAST(NULL AS VARCHAR) AS error
    FROM (SELECT vec_id, 'A' || (vec_id % 7 + 13) || 'x13  B13x' || (vec_id % 5 + 16) AS t FROM embeddings)"""
)
def read_pages(spark, folder):
    """The whole way from image to text: a stand-in finds two boxes side by side, as large as the first two pixels say; another reads the sizes of
    their padded crops."""
    tag = F.concat(F.lpad(F.hex(F.col("vec_id") % 7 + 5), 2, "0"), F.lpad(F.hex(F.col("vec_id") % 5), 2, "0"))
    images = read(spark, folder, "embeddings").select("vec_id", F.lit(200).alias("width"), F.lit(100).alias("height"), F.lit(1).alias("channels"), F.unhex(F.concat(tag, F.repeat(F.lit("00"), F.lit(200 * 100 - 2)))).alias("data"))

    def detector():
        def find(img):
            w, h = int(img[0, 0]), int(img[0, 1])
            return [[(100, 40), (105, 40), (105, 48 + h), (100, 48 + h)], [(10, 40), (10 + w, 40), (10 + w, 45), (10, 45)]]

        return find

    def reader():
        return lambda img: (f"{'A' if img.shape[0] == 13 else 'B'}{img.shape[1]}x{img.shape[0]}", 0.75)

    return models.read_pages(images, "vec_id", detector, reader, None, "vietocr")


@query(
    """SELECT line_id, text AS base_text, lower(text) AS tuned_text, trim(lower(text)) AS corrected_text, text IS DISTINCT FROM lower(text) AS tuned_changed, lower(text) IS DISTINCT FROM trim(lower(text)) AS corrected_changed FROM train"""
)
def compare_models(spark, folder):
    t = read(spark, folder, "train")
    low = t.select("line_id", F.lower("text").alias("text"))
    return models.compare(t.select("line_id", "text"), low, low.select("line_id", F.trim("text").alias("text")), ["line_id"])


@query(
    r"""SELECT token, length(token) < 2 OR starts_with(token, '__SHIELD_ENT_') OR regexp_full_match(token, '\d+') OR regexp_matches(token, '[@/:#$%]') AS bypassed,
        (length(b) > 0 AND length(regexp_replace(b, '[^0-9]', '', 'g')) >= 0.35 * length(b)) OR regexp_matches(token, '(?i)^(mst|stk|tel|fax|sđt|đt)') AS mostly_digits
    FROM (SELECT token, regexp_replace(token, '[\s.,\-/:()]', '', 'g') AS b FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS token FROM train) WHERE token <> '')"""
)
def token_kinds(spark, folder):
    toks = read(spark, folder, "train").select(F.explode(F.split("text", r"\s+")).alias("token")).where("token <> ''").distinct()
    return toks.select("token", lexicon.bypass(F.col("token")).alias("bypassed"), A.mostly_digits(F.col("token")).alias("mostly_digits"))


@query(
    """SELECT DISTINCT o AS original, CASE WHEN o = upper(o) AND o <> lower(o) AND length(o) > 1 THEN upper(w) WHEN substr(o, 1, 1) <> lower(substr(o, 1, 1)) THEN upper(substr(w, 1, 1)) || substr(w, 2) ELSE w END AS word
    FROM (SELECT unnest(regexp_split_to_array(text, ' ')) AS o FROM train), (SELECT 'đường' AS w)"""
)
def recased(spark, folder):
    toks = read(spark, folder, "train").select(F.explode(F.split("text", " ")).alias("original")).distinct()
    return toks.select("original", T.like_case(F.col("original"), F.lit("đường")).alias("word"))


# --- sources and sinks: written to a shared folder and read again

@query("SELECT rel_img, nfc_normalize(rtrim(regexp_replace(text, '[\t\r\n]+', ' ', 'g'))) AS text FROM train WHERE rel_img IS NOT NULL AND text IS NOT NULL")
def label_files(spark, folder):
    to = shared_folder(spark, "labels-")
    W.write_labels(read(spark, folder, "train"), to)
    return R.read_labels(spark, to)


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN line_id % 9 = 0 THEN 'val' ELSE 'train' END AS split FROM train WHERE rel_img IS NOT NULL AND text IS NOT NULL) GROUP BY split")
def label_files_by_split(spark, folder):
    to = shared_folder(spark, "labels-")
    W.write_labels(read(spark, folder, "train").withColumn("split", F.when(F.col("line_id") % 9 == 0, "val").otherwise("train")), to, "split")
    return R.read_labels(spark, f"{to}/split=val").select(F.lit("val").alias("split")).unionAll(R.read_labels(spark, f"{to}/split=train").select(F.lit("train").alias("split"))).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT n_name AS rel_img, 'số ' || n_nationkey AS text FROM nation")
def label_map(spark, folder):
    to = shared_folder(spark, "map-")
    read(spark, folder, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.concat(F.lit("số "), "n_nationkey"))))).alias("value")).write.text(to)
    return R.read_label_map(spark, to)


@query("SELECT lower(r_name) AS w1, 'x' AS w2, CASE WHEN r_regionkey = 1 THEN 99 ELSE r_regionkey END::BIGINT AS cnt FROM region UNION ALL SELECT 'new', 'x', 7::BIGINT")
def ngram_overlay(spark, folder):
    """Counts of a file, and those of another where both have the n-gram; n-grams of another length don't count."""
    region, tables = read(spark, folder, "region"), []
    key = F.concat(F.lower("r_name"), F.lit("_x"))
    base = region.select(key.alias("k"), F.col("r_regionkey").cast("bigint").alias("n")).unionAll(region.select(F.concat(key, F.lit("_y")), F.lit(5).cast("bigint")))
    over = region.where("r_regionkey = 1").select(key.alias("k"), F.lit(99).cast("bigint").alias("n")).unionAll(spark.createDataFrame([("new_x", 7)], "k string, n bigint"))
    for t in (base, over):
        to = shared_folder(spark, "ngrams-")
        t.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "n")))).alias("value")).write.text(to)
        tables.append(R.read_ngrams(spark, to, 2))
    return lexicon.overlay(*tables, ["w1", "w2"])


@query("SELECT DISTINCT lower(trim(nfc_normalize(w))) AS word FROM (SELECT unnest(regexp_split_to_array(text, '[\n\r]')) AS w FROM train) WHERE lower(trim(nfc_normalize(w))) <> ''")
def lexicon_file(spark, folder):
    to = shared_folder(spark, "lexicon-")
    read(spark, folder, "train").where("text is not null").select(F.explode(F.split("text", "[\n\r]")).alias("value")).write.text(to)
    return lexicon.lexicon_from_lines(spark.read.text(to))


@query("SELECT count(*) AS n_texts, sum(length(t)) AS n_chars, count(DISTINCT t) AS n_distinct FROM (SELECT trim(regexp_replace(text, '[\n\r]', ' ', 'g')) AS t FROM train) WHERE t <> ''")
def text_export(spark, folder):
    to = shared_folder(spark, "texts-")
    W.write_texts(read(spark, folder, "train").withColumn("text", F.regexp_replace("text", "[\n\r]", " ")), to)
    return spark.read.text(to).agg(F.count("*").alias("n_texts"), F.sum(F.length("value")).alias("n_chars"), F.countDistinct("value").alias("n_distinct"))


@query("SELECT split, count(*) AS n, count(DISTINCT sample_id) AS n_ids FROM train_annotation WHERE split IS NOT NULL GROUP BY split")
def table_rebuild(spark, folder):
    """A table written twice under one name, parted by split: the second takes the place of the first."""
    to, t = shared_folder(spark, "table-"), read(spark, folder, "train_annotation").where("split is not null")
    for rows in (t.unionAll(t), t):
        W.write_table(rows, to, "split")
    return spark.read.parquet(to).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("n_ids"))


@query("SELECT sample_id, upper(label) AS label FROM train_annotation")
def rewrite_twice(spark, folder):
    """A table derived from its unchanged source, twice: the same comes out."""
    to, source = shared_folder(spark, "derived-"), read(spark, folder, "train_annotation").select("sample_id", "label")
    for _ in range(2):
        W.rewrite_from_source(lambda d: d.withColumn("label", F.upper("label")), source, to)
    return spark.read.parquet(to)


@query("SELECT ch, row_number() OVER (ORDER BY ch) AS position FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM train) WHERE NOT regexp_matches(ch, '^\s$')")
def dictionary_file(spark, folder):
    """The characters by code point, as their file has them."""
    to = shared_folder(spark, "characters-")
    W.write_dictionary(D.char_dictionary(read(spark, folder, "train"), "text"), to)
    whole = spark.read.text(to, wholetext=True).where("value <> ''")  # one file
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("p", "ch")).select("ch", (F.col("p") + 1).cast("bigint").alias("position"))


@query("SELECT * FROM (VALUES ('dpi', '300'), ('engine', 'dual'), ('lang', 'vi'), ('mode', 'fit_image'), ('title', 'Số')) t(name, value)")
def option_files(spark, folder):
    """Options of a file over defaults, with an old value renamed; broken and missing files give the defaults."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as d:  # the driver's own
        path = os.path.join(d, "options.json")
        W.write_options(path, {"engine": "both", "dpi": 300, "title": "Số"})
        got = R.read_options(path, {"engine": "paddle", "dpi": 200, "lang": "vi", "mode": "fit_image"}, {"engine": {"both": "dual"}})
        assert R.read_options(os.path.join(d, "none.json"), {"a": 1}) == {"a": 1}
    return spark.createDataFrame([(k, str(v)) for k, v in got.items()], "name string, value string")


@query("SELECT 'second' AS found, TRUE AS none_large_enough")
def model_files(spark, folder):
    """The first model file that is there and large enough."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as d:  # the driver's own
        for name, size in (("first", 10), ("second", 2000), ("third", 3000)):
            with open(os.path.join(d, name), "wb") as f:
                f.write(b"x" * size)
        paths = [os.path.join(d, n) for n in ("none", "first", "second", "third")]
        found, none = R.first_existing(paths, 1000), R.first_existing(paths, 10_000)
    return spark.createDataFrame([(os.path.basename(found), none is None)], "found string, none_large_enough boolean")


def _image_files(spark: SparkSession, folder: str) -> str:
    """A folder of portable images, twenty pages a file, and one that can't be read; every third file is named .ppm."""
    to = shared_folder(spark, "images-")
    pages_ = W.encode(_images(spark, folder), ["vec_id"], [lambda *_: 1 // 0, W.encode_portable])  # the first encoder fails
    named = pages_.withColumn("f", F.floor(F.col("vec_id") / 20)).groupBy("f").agg(F.array_sort(F.collect_list(F.struct("vec_id", "encoded"))).alias("e"))
    whole = named.select(
        F.concat(F.lit("d/Page_"), "f", F.when(F.col("f") % 3 == 0, ".ppm").otherwise(".PGM")).alias("name"),
        F.unhex(F.array_join(F.transform("e", lambda x: F.hex(x["encoded"])), "")).alias("data"),
    )
    broken = spark.createDataFrame([("d/page_x.pgm", bytearray(b"P5 nothing")), ("d/notes.txt", bytearray(b"x"))], "name string, data binary")
    assert W.write_bytes(whole.unionAll(broken), "name", "data", W.file_writer(to)).where("error is not null").count() == 0
    return to


_FILES = "(SELECT vec_id // 20 AS f, 'Page_' || (vec_id // 20) || CASE WHEN (vec_id // 20) % 3 = 0 THEN '.ppm' ELSE '.PGM' END AS name FROM embeddings)"


@query(f"SELECT name, row_number() OVER (ORDER BY f) AS ordinal FROM (SELECT DISTINCT f, name FROM {_FILES}) UNION ALL SELECT 'page_x.pgm', 1 + max(f) - min(f) + 1 FROM {_FILES}")
def folder_scan(spark, folder):
    """The images of a folder as people sort them; other files are left out."""
    files = R.scan_folder(spark, _image_files(spark, folder)).select("path")
    return pages.ordinals(files).select("name", F.col("ordinal").cast("bigint").alias("ordinal"))


@query(f"SELECT name FROM (SELECT DISTINCT f, name FROM {_FILES}) ORDER BY f LIMIT 4")
def first_files(spark, folder):
    """The first part of a list that counts as large."""
    return R.first_part(R.scan_folder(spark, _image_files(spark, folder)), large=5, first=4).select("name")


@query(f"(SELECT name FROM (SELECT DISTINCT f, name FROM {_FILES} WHERE f % 3 = 0) ORDER BY f LIMIT 2) UNION ALL (SELECT name FROM (SELECT DISTINCT f, name FROM {_FILES} WHERE f % 3 <> 0) ORDER BY f LIMIT 2)")
def sampled_files(spark, folder):
    return R.sample_files(R.scan_folder(spark, _image_files(spark, folder)), ("ppm", "pgm"), 2).select("name")


@query(f"SELECT name, row_number() OVER (ORDER BY f) AS place FROM (SELECT DISTINCT f, name FROM {_FILES} WHERE f IN (0, 2, 10, 11))")
def file_list(spark, folder):
    """Given files in natural order."""
    named = R.scan_folder(spark, _image_files(spark, folder)).where("name rlike '_(0|2|10|11)[.]'").select("path")
    paths = [r[0] for r in named.collect()]
    listed = R.file_list(spark, paths).select("name", F.monotonically_increasing_id().alias("m"))
    return pages.numbered(listed, ["m"], "place").select("name", "place")


@query(
    f"""SELECT 'Page_' || (vec_id // 20) AS stem, CAST(row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) - 1 AS INTEGER) AS page_index, CAST(count(*) OVER (PARTITION BY vec_id // 20) AS INTEGER) AS total_pages,
        array_to_string({_HEX.format(_PX)}, '') AS pixels, FALSE AS failed FROM embeddings UNION ALL SELECT 'page_x', 0, 0, NULL, TRUE"""
)
def page_decode(spark, folder):
    """The pages of the files of a folder; a file that can't be read has no image but an error."""
    files = R.scan_folder(spark, _image_files(spark, folder), content=True)
    decoded = R.pages(files, R.decode_portable)
    return decoded.select(T.stem_of_file("path").alias("stem"), "page_index", "total_pages", F.lower(F.hex("data")).alias("pixels"), F.col("error").isNotNull().alias("failed"))


@query(
    """SELECT file_path, count(*) AS n_pages, md5(string_agg(coalesce(layer, ''), '|' ORDER BY page_index, result_id)) AS layers
    FROM (SELECT file_path, page_index, result_id, full_text AS layer FROM ocr_result WHERE file_path IS NOT NULL) GROUP BY file_path"""
)
def document_layers(spark, folder):
    r = read(spark, folder, "ocr_result").where("file_path is not null").select("file_path", F.struct("page_index", "result_id").alias("o"), F.coalesce("full_text", F.lit("")).alias("layer"))
    layers = W.document_layers(r, "file_path", "o", "layer")
    return layers.select("file_path", F.size("layers").cast("bigint").alias("n_pages"), F.md5(F.array_join("layers", "|")).alias("layers"))


@query("SELECT page_id, count(*) AS n_runs, md5(string_agg(text, chr(10) ORDER BY box_id, box_key)) AS texts FROM ocr_box WHERE trim(text) <> '' AND NOT regexp_matches(text, '^\s*$') GROUP BY page_id")
def searchable_pdf(spark, folder):
    """A PDF of each page with its texts over an image of one pixel, and what is read back from its bytes."""
    b = read(spark, folder, "ocr_box").where("trim(text) <> '' and text rlike '\\\\S'").withColumn("g", G.page_geometry(F.col("img_w"), F.col("img_h"), F.lit("a4_portrait"), F.lit(300.0)))
    c = F.col
    at = G.text_position(c("x"), c("y"), c("w"), c("h"), c("img_w"), c("img_h"), c("g"))
    run = F.struct("box_id", "box_key", F.struct("text", at["x"].alias("x"), at["baseline"].alias("baseline"), at["font_size"].alias("font_size")).alias("t"))
    whole = b.groupBy("page_id").agg(F.min("g").alias("g"), F.array_sort(F.collect_list(run)).alias("r")).select(
        "page_id", "g.*", F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(1).alias("channels"), F.unhex(F.lit("C8")).alias("data"), F.transform("r", lambda x: x["t"]).alias("texts"), F.lit(0).alias("o")
    )

    def texts(batches):
        import pandas as pd

        for batch in batches:
            read_back = [[t for page in W.pdf_texts(bytes(p)) for t in page] for p in batch["pdf"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "texts": read_back})

    back = W.pdf_documents(whole, "page_id", "o").mapInPandas(texts, "page_id bigint, texts array<string>")
    return back.select("page_id", F.size("texts").cast("bigint").alias("n_runs"), F.md5(F.array_join("texts", "\n")).alias("texts"))


@query(
    f"""WITH p AS (SELECT vec_id, CAST(floor(list_avg(px)) AS BIGINT) AS m, list_min(px) AS low FROM (SELECT vec_id, {_PX} AS px FROM embeddings))
    SELECT vec_id, 'số ' || m AS text, CASE WHEN low < 60 THEN 0.98 ELSE 0.8 END::DOUBLE AS conf, CASE WHEN low < 60 THEN 'cross_verified' ELSE 'vietocr' END AS winner FROM p"""
)
def recognize_dual(spark, folder):
    """Both recognisers over the images, with stand-ins that read the mean and the darkest pixel."""

    def viet():
        return lambda img: (f"số {int(np.mean(img))}", 0.8)

    def paddle():
        return lambda img: (f"so {int(np.mean(img))}" if img.min() < 60 else "", 0.9)

    return models.read_crops(_images(spark, folder), ["vec_id"], viet, paddle)


# --- streams, read to their end

@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_failed FROM events WHERE ts IS NOT NULL GROUP BY 1")
def stream_progress(spark, folder):
    stream = spark.readStream.schema(read(spark, folder, "events").schema).parquet(f"{folder}/events.parque[t]")
    failed = F.when(F.col("event_type") == "error", "x")
    df = S.progress(stream.withColumn("failed", failed), "ts", late="3650 days", failed="failed")
    return S.run_once(df, "complete")


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_latest(spark, folder):
    stream = spark.readStream.schema(read(spark, folder, "events").schema).parquet(f"{folder}/events.parque[t]")
    df = S.latest_results(stream.select("user_id", "event_id", "ts"), ["user_id"], "event_id")
    return S.run_once(df, "complete")
