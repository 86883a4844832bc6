"""Text, duration, score and key functions over the segment tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import arrays, keys, scores, text
from cadenza.operators import candidates
from cadenza.plans.registry import Registry
from cadenza.sources.tables import spread, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


# SQL building blocks, written independently of the column expressions
def s_base(c: str) -> str:
    return f"split_part(split_part(lower(trim(coalesce({c}, ''))), '-', 1), '_', 1)"


def s_word(w: str, english: str) -> str:
    g = f"len(regexp_extract_all({w}, '[{text.VOWELS}]+'))"
    return f"greatest(1, {g} - CASE WHEN {english} AND {g} > 1 AND {w} LIKE '%e' AND {w} NOT LIKE '%le' THEN 1 ELSE 0 END)"


def s_syllables(t: str, lang: str) -> str:
    words = f"regexp_extract_all(lower({t}), '\\p{{L}}+')"
    return f"CASE WHEN trim(coalesce({t}, ''), chr(10) || chr(9) || chr(13) || ' ') = '' THEN 0 ELSE coalesce(list_sum(list_transform({words}, lambda w: {s_word('w', s_base(lang) + " = 'en'")})), 0) END"


def s_rate(lang: str) -> str:
    return f"CASE {s_base(lang)} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in text.RATES.items()) + f" ELSE {text.DEFAULT_RATE} END"


def s_count(t: str, chars: str) -> str:
    return f"(length({t}) - length(translate({t}, '{chars}', '')))"


def s_duration(t: str, lang: str, syl: str) -> str:
    speech = f"({syl} / (({s_rate(lang)}) * 1.25))"
    raw = f"({s_count(t, text.SENTENCE_MARKS)} * 0.25 + {s_count(t, text.CLAUSE_MARKS)} * 0.12)"
    return f"CASE WHEN {syl} = 0 AND trim({t}) = '' THEN 0.0 ELSE {speech} + least({raw}, CASE WHEN {speech} > 0 THEN 0.3 * {speech} ELSE 1.0 END) END"


def s_fidelity(a: str, b: str) -> str:
    a, b = (f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')" for x in (a, b))
    r = f"(length({b}) / length({a}))"
    return (
        f"CASE WHEN length({a}) = 0 THEN CASE WHEN length({b}) > 0 THEN 1.0 ELSE 0.0 END WHEN {r} BETWEEN 0.7 AND 1.8 THEN 1.0 "
        f"ELSE greatest(0.0, least(1.0, 1 - (CASE WHEN {r} < 0.7 THEN 0.7 - {r} ELSE {r} - 1.8 END) / 1.2)) END"
    )


def s_penalty(x: str) -> str:
    return f"CASE WHEN {x} BETWEEN 0.9 AND 1.15 THEN 0.0 ELSE greatest(0.0, least(1.0, (CASE WHEN {x} < 0.9 THEN 0.9 - {x} ELSE {x} - 1.15 END) / 0.6)) END"


LANG = "coalesce(target_lang, '')"


@query(
    f"""WITH s AS (SELECT DISTINCT seg_uid, target_text AS t, target_lang AS l FROM timeline_segment WHERE target_text IS NOT NULL),
    n AS (SELECT *, {s_syllables('t', 'l')} AS syl FROM s)
    SELECT seg_uid, CAST(syl AS INT) AS syllables, {s_duration('t', 'l', 'syl')} AS seconds FROM n"""
)
def str_duration(spark, d):
    rows = spread(table(spark, d, "timeline_segment").select("seg_uid", "target_text", "target_lang").where("target_text is not null")).distinct()
    rows = rows.withColumn("syllables", text.syllables(F.col("target_text"), F.col("target_lang")))
    return rows.select("seg_uid", "syllables", text.duration(F.col("target_text"), F.col("target_lang"), counted=F.col("syllables")).alias("seconds"))


@query(
    f"""SELECT target_lang, {s_base('target_lang')} AS duration_code,
    CASE WHEN lower(trim(target_lang)) IN ('pt','pt-br','pt-pt','portuguese') THEN 'pt' WHEN lower(trim(target_lang)) IN ('en','en-us','en-gb','english') THEN 'en'
         WHEN lower(trim(target_lang)) IN ('es','es-es','es-mx','spanish') THEN 'es' ELSE split_part(lower(trim(coalesce(target_lang,''))), '-', 1) END AS translate_code, count(*) AS n
    FROM timeline_segment GROUP BY ALL"""
)
def str_language_codes(spark, d):
    c = F.col("target_lang")
    return table(spark, d, "timeline_segment").groupBy("target_lang", text.base_language(c).alias("duration_code"), text.translation_language(c).alias("translate_code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH w AS (SELECT row_id, list_filter(regexp_split_to_array(regexp_replace(coalesce(source_text,''), '[\\x00-\\x08\\x0b-\\x1f]', '', 'g'), '\\s+'), lambda x: x <> '') AS t FROM transcript_segment WHERE source_text IS NOT NULL),
    l AS (SELECT row_id, t, list_transform(t, lambda x: lower(x)) AS k FROM w)
    SELECT row_id, array_to_string(list_filter(t, lambda x, i: NOT (i > 1 AND k[i] = k[i-1] AND (coalesce(i > 2 AND k[i] = k[i-2], false) OR coalesce(k[i] = k[i+1], false)))), ' ') AS cleaned FROM l"""
)
def str_clean_transcript(spark, d):
    rows = spread(table(spark, d, "transcript_segment").select("row_id", "source_text").where("source_text is not null"))
    return rows.select("row_id", text.clean_transcript(F.col("source_text")).alias("cleaned"))


@query()
def str_drop_corrupt_tokens(spark, d):
    rows = table(spark, d, "documents").where(F.contains("text", F.lit("�")))
    return rows.select("doc_id", text.clean_transcript(F.col("text")).alias("cleaned"))


FILLER_SQL = "|".join(sorted(text.PT_FILLERS, key=len, reverse=True))


@query(
    f"""WITH p AS (SELECT DISTINCT seg_uid, regexp_replace(target_text, '^\\s+|\\s+$', '', 'g') AS t FROM timeline_segment WHERE {s_base('target_lang')} = 'pt' AND target_text IS NOT NULL),
    a AS (SELECT *, regexp_replace(t, '^(?:(?:{FILLER_SQL})\\s*,\\s*)+(\\S)', '\\1', 'i') AS f FROM p),
    b AS (SELECT *, CASE WHEN f <> t THEN upper(f[1]) || f[2:] ELSE t END AS g FROM a),
    c AS (SELECT *, regexp_replace(g, '^(?:{"|".join(text.PT_PRONOUNS)})\\s+([A-Za-zÀ-ÿ])', '\\1', 'i') AS h FROM b),
    e AS (SELECT *, regexp_replace(CASE WHEN h <> g THEN upper(h[1]) || h[2:] ELSE g END, '\\s+', ' ', 'g') AS o FROM c)
    SELECT seg_uid, o AS condensed FROM e WHERE o <> '' AND length(o) < length(t)"""
)
def str_condense(spark, d):
    rows = table(spark, d, "timeline_segment").where(text.base_language(F.col("target_lang")) == "pt").select("seg_uid", "target_text", "target_lang").distinct()
    return rows.select("seg_uid", text.condense(F.col("target_text"), F.col("target_lang")).alias("condensed")).where("condensed is not null")


TERMS = ["subtitle", "the old man", "old", "roteiro", "microphone"]


@query(
    """WITH a AS (SELECT DISTINCT seg_uid, target_text AS t FROM timeline_segment WHERE target_text IS NOT NULL),
    b AS (SELECT seg_uid, t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'the old man', '__ENT_1__', 'gi'), 'microphone', '__ENT_4__', 'gi'), 'subtitle', '__ENT_0__', 'gi'), 'roteiro', '__ENT_3__', 'gi'), 'old', '__ENT_2__', 'gi') AS p FROM a)
    SELECT seg_uid, p AS protected, replace(replace(replace(replace(replace(p, '__ENT_0__', 'subtitle'), '__ENT_1__', 'the old man'), '__ENT_2__', 'old'), '__ENT_3__', 'roteiro'), '__ENT_4__', 'microphone') AS restored FROM b WHERE p <> t"""
)
def str_entity_protection(spark, d):
    rows = table(spark, d, "timeline_segment").where("target_text is not null").select("seg_uid", "target_text").distinct()
    guarded = rows.withColumn("protected", text.protect(F.col("target_text"), TERMS))
    return guarded.where("protected <> target_text").select("seg_uid", "protected", text.restore(F.col("protected"), TERMS).alias("restored"))


@query(
    """SELECT DISTINCT workspace_id, trim(regexp_replace(lower(workspace_id), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_extract(workspace_id, '-([0-9]{8})-', 1) AS stamp,
    regexp_extract(workspace_id, '-([0-9a-f]{8})$', 1) AS digest, regexp_extract(workspace_id, '^(.*)-[0-9]{8}-[0-9a-f]{8}$', 1) AS name FROM timeline"""
)
def str_workspace_ids(spark, d):
    w = F.col("workspace_id")
    part = lambda p: F.regexp_extract(w, p, 1)
    return table(spark, d, "timeline").select(
        w, text.slug(w).alias("slug"), part("-([0-9]{8})-").alias("stamp"), part("-([0-9a-f]{8})$").alias("digest"), part("^(.*)-[0-9]{8}-[0-9a-f]{8}$").alias("name")
    ).distinct()


@query(
    """WITH t AS (SELECT DISTINCT seg_uid, target_text AS x, CAST(floor(start_s * 100 + 0.5) AS BIGINT) AS c FROM timeline_segment WHERE start_s IS NOT NULL AND target_text IS NOT NULL)
    SELECT seg_uid, printf('%02d:%02d:%02d.%02d', c // 360000, (c // 6000) % 60, (c // 100) % 60, c % 100) AS clock,
    CASE WHEN regexp_replace(x, '^\\s+|\\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '\\s+')) END AS words,
    regexp_matches(x, '[.?!]$') AS ends, lower(trim(x)) IN ('1','true','yes','y','on','t') AS truthy FROM t"""
)
def str_clock_and_words(spark, d):
    x = F.col("target_text")
    rows = table(spark, d, "timeline_segment").where("start_s is not null and target_text is not null").select("seg_uid", "target_text", "start_s").distinct()
    return rows.select("seg_uid", text.clock(F.col("start_s")).alias("clock"), text.word_count(x).alias("words"), x.rlike("[.?!]\\z").alias("ends"), text.to_bool(x).alias("truthy"))


@query(
    """WITH t AS (SELECT DISTINCT seg_uid, source_text AS x FROM timeline_segment WHERE source_text IS NOT NULL)
    SELECT seg_uid FROM t WHERE trim(lower(x), '[]().,?!') IN ('laughter','chuckle','sigh','breath','breathing','cough','gasp','humming') OR (x LIKE '[%' AND x LIKE '%]') OR (x LIKE '(%' AND x LIKE '%)')"""
)
def fil_non_speech(spark, d):
    rows = table(spark, d, "timeline_segment").where("source_text is not null").select("seg_uid", "source_text").distinct()
    return rows.where(text.is_vocal_event(F.col("source_text"))).select("seg_uid")


@query(
    """WITH t AS (SELECT DISTINCT seg_uid, source_text AS a, target_text AS b, timing.slot_duration_s AS slot, timing.estimated_duration_s AS est, timing.score AS sc FROM timeline_segment WHERE timing IS NOT NULL)
    SELECT seg_uid, """
    + s_fidelity("coalesce(a,'')", "coalesce(b,'')")
    + " AS fidelity, "
    + s_penalty("(est / slot)")
    + """ AS penalty,
    CASE WHEN slot <= 0 THEN false WHEN est > slot THEN abs(est-slot)/greatest(slot,0.05) > 0.10 AND abs(est-slot) > 0.12 ELSE abs(est-slot)/greatest(slot,0.05) > 0.25 AND abs(est-slot) > 0.35 END AS correct,
    CASE WHEN slot > 0 AND est > slot * (1 + 0.1) AND least(est / slot, 1.35) > 1.001 THEN least(est / slot, 1.35) END AS speed,
    coalesce(sc < 0.6, false) AS review, est / slot BETWEEN 0.9 AND 1.15 AS natural
    FROM t WHERE slot > 0 AND est IS NOT NULL"""
)
def math_timing_scores(spark, d):
    est, slot = F.col("est"), F.col("slot")
    rows = table(spark, d, "timeline_segment").select("seg_uid", "source_text", "target_text", F.col("timing.slot_duration_s").alias("slot"), F.col("timing.estimated_duration_s").alias("est"), F.col("timing.score").alias("sc")).where("slot > 0 and est is not null").distinct()
    return rows.select(
        "seg_uid", scores.fidelity(F.col("source_text"), F.col("target_text")).alias("fidelity"), scores.rate_penalty(est / slot).alias("penalty"), scores.needs_correction(est, slot).alias("correct"),
        scores.next_speed(est, slot, F.lit(1.0)).alias("speed"), scores.low_confidence(F.col("sc")).alias("review"), (est / slot).between(0.90, 1.15).alias("natural"),
    )


@query(
    """SELECT DISTINCT workspace_id, speaker, profile_id, greatest(0.0, least(1.0, score)) * 40 + CASE WHEN reference_duration < 1 THEN 0.0 WHEN reference_duration < 8 THEN reference_duration / 8 * 30 WHEN reference_duration <= 12 THEN 30.0
      ELSE greatest(0.0, 30 - (reference_duration - 12) * 2) END + greatest(0.0, least(1.0, voiced_frac)) * 10 + CASE WHEN reference_duration > 5 THEN 20.0 ELSE 0.0 END
      + CASE WHEN voiced_frac >= 0.7 THEN 25.0 WHEN voiced_frac >= 0.4 THEN 25 * (voiced_frac - 0.4) / 0.3 ELSE -20.0 END AS quality,
      CASE WHEN segments_used >= 3 THEN 'large' WHEN segments_used >= 1.5 THEN 'medium' ELSE 'small' END AS tier
    FROM speaker_profile WHERE score IS NOT NULL"""
)
def math_chunk_quality(spark, d):
    p = table(spark, d, "speaker_profile").where("score is not null")
    q = scores.chunk_quality(F.col("score") * 40, F.col("reference_duration"), F.col("voiced_frac") / 10, F.col("voiced_frac"))
    return p.select("workspace_id", "speaker", "profile_id", q.alias("quality"), scores.memory_tier(F.col("segments_used")).alias("tier")).distinct()


@query(
    """SELECT event_id, CASE WHEN value * 40 > 2500 AND value / 100 > 0.1 THEN 'applause' WHEN value * 40 > 2000 AND value * 100 > 2000 THEN 'cheers' WHEN value * 40 > 300 AND value * 40 < 2000 AND value / 100 < 0.15 THEN 'laughter' ELSE 'reaction' END AS kind,
    CASE WHEN value > 1e-9 THEN 20 * log10(value) ELSE -120.0 END AS db FROM events"""
)
def math_reaction_class(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", scores.reaction_class(v * 40, v * 100, v / 100).alias("kind"), scores.decibels(v).alias("db"))


@query(
    """WITH r AS (SELECT DISTINCT run_id, iteration, try_cast(parameters['generate.max_speed'] AS DOUBLE) AS v, try_cast(parameters['omnivoice.num_step'] AS DOUBLE) AS n, try_cast(parameters['samples.target_seconds'] AS DOUBLE) AS t,
      try_cast(parameters['samples.max_seconds'] AS DOUBLE) AS m FROM iteration_record)
    SELECT run_id, iteration, greatest(1.1, least(1.6, v)) AS speed, round(greatest(16.0, least(64.0, n))) AS steps, least(t, m) AS target FROM r WHERE v IS NOT NULL AND n IS NOT NULL AND t IS NOT NULL AND m IS NOT NULL"""
)
def math_coerce_parameters(spark, d):
    p = lambda k: F.col("parameters")[k].try_cast("double")
    rows = table(spark, d, "iteration_record").select("run_id", "iteration", p("generate.max_speed").alias("v"), p("omnivoice.num_step").alias("n"), p("samples.target_seconds").alias("t"), p("samples.max_seconds").alias("m"))
    rows = rows.where("v is not null and n is not null and t is not null and m is not null").distinct()
    return rows.select("run_id", "iteration", scores.coerce_parameter(F.col("v"), 1.1, 1.6).alias("speed"), scores.coerce_parameter(F.col("n"), 16, 64, True).alias("steps"), F.least("t", "m").alias("target"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x*x))) AS l2, list_sort(list_transform(v, lambda x: abs(x))) AS s FROM e)
    SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: x*x)) / len(v)) AS rms, list_transform(v, lambda x: x / l2)[1] AS first_unit,
    20 * log10(greatest((list_sum(s[len(s) - len(v)//5 + 1:]) / (len(v)//5)) / (list_sum(s[1:len(v)//5]) / (len(v)//5)), 1e-12)) AS snr, list_max(list_transform(v, lambda x: abs(x))) AS peak FROM n"""
)
def arr_levels(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", arrays.rms(v).alias("rms"), arrays.unit(v)[0].alias("first_unit"), arrays.snr(v).alias("snr"), F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))).alias("peak"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
    SELECT a.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1]*p[2])) / (sqrt(list_sum(list_transform(a.v, lambda x: x*x))) * sqrt(list_sum(list_transform(b.v, lambda x: x*x)))) AS cosine, (a.v[1] + b.v[1]) / 2 AS mono
    FROM e a JOIN e b ON b.vec_id = a.vec_id + 1"""
)
def arr_cosine(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", arrays.cosine(F.col("embedding"), F.col("other")).alias("cosine"), arrays.mono(F.col("embedding"), F.col("other"))[0].alias("mono"))


@query()
def arr_reshape(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(
        "vec_id", arrays.stretched(v, 16).alias("short"), arrays.padded(v, 80).alias("long"), arrays.crossfaded(v, v, 8).alias("faded"), arrays.peak_normalised(v).alias("peak"),
        arrays.rms_normalised(v).alias("level"), arrays.ending_score(v, 8).alias("ending"),
    )


@query(
    """WITH s AS (SELECT DISTINCT seg_uid, target_text AS t, speaker AS sp, target_lang AS l, timing.slot_duration_s AS slot FROM timeline_segment)
    SELECT seg_uid, sha256(concat(regexp_replace(coalesce(t,''), '^\\s+|\\s+$', '', 'g'), '||', coalesce(sp,''), '||', coalesce(l,''), '||||tts-a||', CAST(CAST(floor(coalesce(slot,0.0)*1000+0.5) AS BIGINT) AS VARCHAR), '||'))[1:16] AS render_key FROM s"""
)
def hsh_render_key(spark, d):
    rows = table(spark, d, "timeline_segment").select("seg_uid", "target_text", "speaker", "target_lang", F.col("timing.slot_duration_s").alias("slot")).distinct()
    none = F.lit("")
    return rows.select("seg_uid", keys.render_key(F.col("target_text"), F.col("speaker"), F.col("target_lang"), none, F.lit("tts-a"), F.col("slot"), none).alias("render_key"))


@query("SELECT doc_id, sha256(text) AS digest, octet_length(CAST(encode(text) AS BLOB)) AS bytes FROM documents WHERE text IS NOT NULL")
def hsh_content(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("bytes"))


@query(
    """WITH c AS (SELECT DISTINCT workspace_id, stage_name, '{' || array_to_string(list_transform(list_filter(list_sort(map_keys(config)), lambda k: k <> 'device'), lambda k: k || ':' || coalesce(config[k], 'null')), ',') || '}' AS canonical FROM stage_record WHERE config IS NOT NULL)
    SELECT *, sha256(canonical) AS digest FROM c"""
)
def jsn_canonical_config(spark, d):
    rows = table(spark, d, "stage_record").where("config is not null").select("workspace_id", "stage_name", keys.canonical_map(F.col("config"), ["device"]).alias("canonical")).distinct()
    return rows.withColumn("digest", F.sha2("canonical", 256))


@query(
    """SELECT DISTINCT workspace_id, speaker, profile_id, concat('e', CAST(floor(coalesce(CASE WHEN score > 1e-9 THEN 20*log10(score) ELSE -120.0 END, 0.0)*10+0.5) AS BIGINT), '|v', CAST(floor(voiced_frac*100+0.5) AS BIGINT), '|r', CAST(floor(reference_duration*100+0.5) AS BIGINT), '|p', segments_used) AS signature
    FROM speaker_profile WHERE score IS NOT NULL"""
)
def str_prosody_signature(spark, d):
    p = table(spark, d, "speaker_profile").where("score is not null")
    sig = keys.prosody_signature(scores.decibels(F.col("score")), F.col("voiced_frac"), F.col("reference_duration"), F.col("segments_used").cast("double"))
    return p.select("workspace_id", "speaker", "profile_id", sig.alias("signature")).distinct()


@query(
    """WITH r AS (SELECT DISTINCT workspace_id, stage_name, try_cast(started_at AS TIMESTAMPTZ) AS a, try_cast(finished_at AS TIMESTAMPTZ) AS b FROM stage_record)
    SELECT workspace_id, stage_name, epoch(b) - epoch(a) AS seconds, strftime(a, '%Y%m%d') AS stamp, date_diff('day', CAST(a AS DATE), DATE '2032-01-01') AS age_days FROM r WHERE a IS NOT NULL AND b IS NOT NULL"""
)
def dt_stage_times(spark, d):
    at = lambda c: F.try_to_timestamp(c)
    rows = table(spark, d, "stage_record").select("workspace_id", "stage_name", at("started_at").alias("a"), at("finished_at").alias("b")).distinct().where("a is not null and b is not null")
    return rows.select("workspace_id", "stage_name", (F.unix_micros("b") - F.unix_micros("a")).cast("double").__truediv__(1e6).alias("seconds"), F.date_format("a", "yyyyMMdd").alias("stamp"), F.date_diff(F.lit("2032-01-01").cast("date"), F.to_date("a")).alias("age_days"))


@query(
    """SELECT DISTINCT run_id, iteration, list_sort(map_keys(map_concat(MAP{'align.tolerance': '0.1', 'extra': 'x'}, parameters))) AS names, len(list_filter(map_keys(parameters), lambda k: k LIKE 'align.%')) AS align_n FROM iteration_record WHERE parameters IS NOT NULL"""
)
def map_merge(spark, d):
    p = F.col("parameters")
    defaults = F.create_map(F.lit("align.tolerance"), F.lit("0.1"), F.lit("extra"), F.lit("x"))
    merged = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(p, k)), p)  # later entries win
    return table(spark, d, "iteration_record").where("parameters is not null").select("run_id", "iteration", F.array_sort(F.map_keys(merged)).alias("names"), F.size(F.map_filter(p, lambda k, v: k.startswith("align."))).alias("align_n")).distinct()


CANDIDATES_SQL = f"""WITH d AS (SELECT doc_id, text, lang, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S')),
  c AS (SELECT doc_id, lang, t AS src, 0 AS pos, 'full' AS backend, t AS cand FROM d
    UNION ALL SELECT doc_id, lang, t, 1, 'first_sentence', regexp_extract(t, '^[^.?!]*[.?!]?', 0) FROM d
    UNION ALL SELECT doc_id, lang, t, 2, 'first_half', substring(t, 1, CAST(floor(length(t) / 2) AS BIGINT)) FROM d),
  u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(cand, '^\\s+|\\s+$', '', 'g')) ORDER BY pos) AS first FROM c WHERE regexp_matches(cand, '\\S')),
  n AS (SELECT *, {s_syllables('cand', 'lang')} AS syl FROM u WHERE first = 1),
  e AS (SELECT *, {s_duration('cand', 'lang', 'syl')} AS est, 0.06 * length(src) AS slot FROM n),
  s AS (SELECT *, 0.45 * greatest(0.0, least(1.0, 1 - abs(est - slot) / slot)) + 0.2 * (1 - ({s_penalty('(est / slot)')})) + 0.2 * ({s_fidelity('src', 'cand')}) + 0.15 AS score FROM e),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, pos) AS k FROM s)
  SELECT doc_id, backend, CAST(syl AS INT) AS syllables, est AS seconds, score FROM r WHERE k = 1"""


@query(CANDIDATES_SQL)
def q_best_candidate(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text")).where(F.col("text").rlike(r"\S")).select("doc_id", "lang", text.stripped(F.col("text")).alias("src"))
    return candidates.best_candidates(docs, "doc_id", F.col("src"), F.col("lang"), F.length("src") * 0.06).select("doc_id", "backend", "syllables", "seconds", "score")


@query(
    """WITH b AS (SELECT * FROM (""" + CANDIDATES_SQL + """))
    SELECT backend, count(*) AS n, avg(score) AS mean_score, count_if(score < 0.6) AS n_review FROM b GROUP BY backend"""
)
def agg_timing_summary(spark, d):
    best = q_best_candidate(spark, d)
    return best.groupBy("backend").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.count_if(F.col("score") < 0.6).alias("n_review"))


@query(
    """WITH s AS (SELECT DISTINCT seg_uid, target_text AS t FROM timeline_segment WHERE target_text IS NOT NULL)
    SELECT seg_uid, list_filter(['subtitle','roteiro','music'], lambda x: NOT contains(lower(t), x)) AS missing, 1 - len(list_filter(['subtitle','roteiro','music'], lambda x: NOT contains(lower(t), x))) / 3 AS compliance FROM s"""
)
def set_missing_terms(spark, d):
    rows = table(spark, d, "timeline_segment").where("target_text is not null").select("seg_uid", "target_text").distinct()
    missing = text.missing_terms(F.col("target_text"), F.array(*[F.lit(x) for x in ("subtitle", "roteiro", "music")]))
    return rows.select("seg_uid", missing.alias("missing"), (1 - F.size(missing) / 3).alias("compliance"))
