"""Queries over reading, standardising, checking and identifying rows."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import functions as F

from ..functions.text import canonical_name, canonical_names_by_table, normalize_token, resolve_round, round_from_id, to_number_lenient
from ..operators import identity, quality, schema
from ..runtime import shared_folder
from ..sources import runs
from ..sources.tables import content_fingerprint, read_result, write_tables
from .registry import query
from .views import FORMULATIONS, formulations, table

KNOWN_BRANDS = [f"Brand#{i}" for i in range(1, 21)]
PDI_LIMIT, SIZE_LIMITS = 0.08, (5.0, 45.0)


def _rules():
    return quality.mixture_rules(KNOWN_BRANDS, ["A", "N"], ["F", "O"])


def _qc(columns):
    return quality.qc_rules(columns, PDI_LIMIT, SIZE_LIMITS)


_BRANDS_SQL = ", ".join(f"'{b}'" for b in KNOWN_BRANDS)
_TOTAL_SQL = "0.0::DOUBLE + IL1_molpct + IL2_molpct + HL_molpct + CHOL_molpct + PEG_molpct"
_INVALID_SQL = f"""list_filter([
  CASE WHEN NOT coalesce(IL1 IN ({_BRANDS_SQL}), false) THEN 'unknown_IL1' END,
  CASE WHEN IL2 NOT IN ({_BRANDS_SQL}) THEN 'unknown_IL2' END,
  CASE WHEN NOT coalesce(Phospholipid IN ('A', 'N'), false) THEN 'unknown_phospholipid' END,
  CASE WHEN NOT coalesce(PEG IN ('F', 'O'), false) THEN 'unknown_PEG' END,
  CASE WHEN NOT ({_TOTAL_SQL} BETWEEN 80 AND 120) THEN 'molar_sum_outside_80_120' END], lambda x: x IS NOT NULL)"""
_QC_SQL = """list_filter([
  CASE WHEN PDI IS NULL THEN 'PDI_missing' END,
  CASE WHEN PDI > 0.08::DOUBLE THEN 'PDI>0.08' END,
  CASE WHEN particle_size IS NULL THEN 'size_missing' END,
  CASE WHEN NOT (particle_size BETWEEN 5 AND 45) THEN 'size_outside_5.0_45.0nm' END], lambda x: x IS NOT NULL)"""
_FLAGGED_SQL = f"{FORMULATIONS}, flagged AS (SELECT *, {_INVALID_SQL} AS bad, {_QC_SQL} AS qc FROM f)"
_REMOVED_SQL = f"""{_FLAGGED_SQL}, removed AS (
  SELECT sample_id, 'invalid_or_template' AS removal_stage, array_to_string(bad, ';') AS removal_reason FROM flagged WHERE len(bad) > 0
  UNION ALL SELECT sample_id, 'QC', array_to_string(qc, ';') FROM flagged WHERE len(bad) = 0 AND len(qc) > 0)"""


def _removed(spark, sf_dir):
    kept, invalid = quality.validate_rows(formulations(spark, sf_dir), _rules())
    _, failed = quality.split_rows(quality.flag_rows(kept, _qc(kept.columns)))
    return quality.union_removed({"invalid_or_template": invalid, "QC": failed})


def cleaned(spark, sf_dir):
    kept, _ = quality.validate_rows(formulations(spark, sf_dir), _rules())
    return quality.split_rows(quality.flag_rows(kept, _qc(kept.columns)))[0]


CLEANED_SQL = f"{_FLAGGED_SQL}, cleaned AS (SELECT * FROM flagged WHERE len(bad) = 0 AND len(qc) = 0)"


@query("qc_reasons", f"WITH {_REMOVED_SQL} SELECT * FROM removed")
def qc_reasons(spark, sf_dir):
    return _removed(spark, sf_dir).select("sample_id", "removal_stage", "removal_reason")


@query("qc_removed_by_reason", f"WITH {_REMOVED_SQL} SELECT removal_stage, removal_reason, count(*) AS n_rows FROM removed GROUP BY ALL")
def qc_removed_by_reason(spark, sf_dir):
    return _removed(spark, sf_dir).groupBy("removal_stage", "removal_reason").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "population_funnel",
    f"""WITH {_FLAGGED_SQL}, counts AS (SELECT count(TE) AS a, count(*) FILTER (TE IS NOT NULL AND len(bad) = 0) AS b,
      count(*) FILTER (TE IS NOT NULL AND len(bad) = 0 AND len(qc) = 0) AS c FROM flagged)
      SELECT 1 AS stage_order, 'target_nonmissing' AS stage, a AS n_rows FROM counts
      UNION ALL SELECT 2, 'after_invalid_template_removal', b FROM counts UNION ALL SELECT 3, 'after_QC', c FROM counts""",
)
def population_funnel(spark, sf_dir):
    rows = formulations(spark, sf_dir)
    failing = lambda rules: F.size(F.array_compact(F.array(*[F.when(r.failing, F.lit(r.reason)) for r in rules]))) > 0
    stages = {
        "target_nonmissing": F.col("TE").isNull(),
        "after_invalid_template_removal": failing(_rules()),
        "after_QC": failing(_qc(rows.columns)),
    }
    return quality.population_funnel(rows, stages)


@query(
    "target_profile_by_stage",
    f"""WITH {FORMULATIONS}, s AS (SELECT DISTINCT CAST(substr(Round, 2) AS INT) AS r FROM f),
      st AS (SELECT row_number() OVER (ORDER BY r)::INT AS stage_order, r FROM s)
      SELECT stage_order, (SELECT string_agg('R' || b.r, '+' ORDER BY b.r) FROM st b WHERE b.r <= st.r) AS stage,
             count(TE) AS n, avg(TE) AS mean, stddev_samp(TE) AS sd, min(TE) AS min, max(TE) AS max
      FROM st JOIN f ON CAST(substr(f.Round, 2) AS INT) <= st.r GROUP BY stage_order, st.r""",
    ["mean", "sd", "min", "max"],
)
def target_profile_by_stage(spark, sf_dir):
    return quality.target_profile_by_stage(formulations(spark, sf_dir), "Round", "TE")


@query(
    "target_range",
    f"""WITH {FORMULATIONS} SELECT min(TE) AS observed_min, max(TE) AS observed_max,
        count(*) FILTER (NOT TE BETWEEN 0.1 AND 0.9) AS n_outside, count(*) FILTER (NOT TE BETWEEN 0.1 AND 0.9) > 0 AS warn FROM f""",
    ["observed_min", "observed_max"],
)
def target_range(spark, sf_dir):
    return quality.value_range_check(formulations(spark, sf_dir), "TE", 0.1, 0.9)


def _raw_headers(spark, sf_dir):
    """Line items and parts under the kind of headers people use."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.col("p_type")
    spelled = F.when(name == "SMALL", "SM-102").when(name == "LARGE", "ckk e12 (CCK12)").when(name == "PROMO", "无").when(name == "MEDIUM", "alc_0315")
    return rows.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.concat(F.lit("R2-"), F.col("l_orderkey").cast("string")).alias("label"),
        spelled.otherwise(name).alias("Ionizable_Lipid_1"),
        F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") == 1, " %").otherwise(" ")).alias(" IL1 mol% "),
        F.lower("l_returnflag").alias("helper_lipid"),
        F.col("l_discount").alias("HL_molpct"),
        F.col("l_linestatus").alias("PEG类型"),
        F.col("p_size").alias("n/p"),
        F.lit("1995").alias("batch"),
    )


@query(
    "standardized_columns",
    """SELECT l_orderkey AS order_key, l_linenumber AS line_number, 'R2-' || l_orderkey AS candidate_id,
        CASE p_type WHEN 'SMALL' THEN 'SM102' WHEN 'LARGE' THEN 'CKK-E12' WHEN 'PROMO' THEN NULL WHEN 'MEDIUM' THEN 'ALC-0315' ELSE p_type END AS IL1,
        CAST(NULL AS VARCHAR) AS IL2, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS IL1_molpct, 0.0::DOUBLE AS IL2_molpct,
        lower(l_returnflag) AS Phospholipid, l_discount AS HL_molpct, 0.0::DOUBLE AS CHOL_molpct, l_linestatus AS PEG,
        0.0::DOUBLE AS PEG_molpct, CAST(p_size AS DOUBLE) AS NP_ratio
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def standardized_columns(spark, sf_dir):
    df, _ = schema.standardize_columns(_raw_headers(spark, sf_dir))
    return df.select(
        "order_key", "line_number", "candidate_id", "IL1", "IL2", "IL1_molpct", "IL2_molpct", "Phospholipid", "HL_molpct", "CHOL_molpct",
        "PEG", "PEG_molpct", "NP_ratio",
    )


@query("lenient_number", "SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9.\\-eE]', '', 'g') AS DOUBLE) AS number FROM events")
def lenient_number(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", to_number_lenient(F.col("props")).alias("number"))


@query("attach_log_target", f"WITH {FORMULATIONS} SELECT sample_id, log10(greatest(price, 1e-12)) AS log_price FROM f", ["log_price"])
def attach_log_target(spark, sf_dir):
    return schema.attach_target(formulations(spark, sf_dir), " PRICE", "log_price", "log10").select("sample_id", "log_price")


@query(
    "align_union",
    """SELECT 'c' || c_custkey AS id, c_acctbal AS customer_balance, 0.0::DOUBLE AS supplier_balance FROM customer
       UNION ALL SELECT 's' || s_suppkey, 0.0::DOUBLE, s_acctbal FROM supplier""",
)
def align_union(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_acctbal").alias("customer_balance"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_acctbal").alias("supplier_balance"))
    return schema.align_features(customers, suppliers)


_ITEM_COLUMNS = sorted(
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
)
_DIGEST_SQL = " || ".join(f"coalesce('V' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'N')" for c in _ITEM_COLUMNS)


@query(
    "content_fingerprint",
    f"""SELECT count(*) AS n_rows, {', '.join(f"CAST(sum(('0x' || substr(d, {16 * i + 1}, 16))::UBIGINT) AS VARCHAR) AS digest_{i + 1}" for i in range(4))}
        FROM (SELECT sha256({_DIGEST_SQL}) AS d FROM lineitem)""",
)
def fingerprint(spark, sf_dir):
    return content_fingerprint(table(spark, sf_dir, "lineitem"))


@query("write_read_results", f"WITH {FORMULATIONS} SELECT Round, IL1, count(*) AS n, min(IL1_molpct) AS low, max(IL1_molpct) AS high FROM f GROUP BY ALL")
def write_read_results(spark, sf_dir):
    """Write result tables of two runs, one of them twice, and read that one back."""
    grouped = formulations(spark, sf_dir).groupBy("Round", "IL1")
    result = grouped.agg(F.count(F.lit(1)).alias("n"), F.min("IL1_molpct").alias("low"), F.max("IL1_molpct").alias("high"))
    path = f"{shared_folder(spark)}/results/{uuid.uuid4().hex}"
    for _ in range(2):
        write_tables({"profile": result}, path, "first", {"source": sf_dir})
    write_tables({"profile": result.where("n < 0")}, path, "second")
    return read_result(spark, path, "profile", "first")


@query(
    "published_run",
    f"""WITH {FORMULATIONS} SELECT Round, sum(n)::BIGINT AS n, count(*) AS n_components, max(best) AS best, any_value(rows_) AS n_rows
        FROM (SELECT Round, IL1, count(*) AS n, max(TE) AS best FROM f GROUP BY ALL), (SELECT count(*)::VARCHAR AS rows_ FROM f) GROUP BY Round""",
    ["best"],
)
def published_run(spark, sf_dir):
    """Two tables published as one run; an attempt that fails between them leaves the published one as it was."""
    rows = formulations(spark, sf_dir)
    path = f"{shared_folder(spark)}/results/{uuid.uuid4().hex}"
    by_component = rows.groupBy("Round", "IL1").agg(F.count(F.lit(1)).alias("n"), F.max("TE").alias("best"))
    with runs.new_run(spark, path, "profile", {"n_rows": rows.count()}) as run:
        run.add("by_component", by_component)
        run.add("rounds", rows.select("Round").distinct())
    with contextlib.suppress(ZeroDivisionError), runs.new_run(spark, path, "profile") as run:
        run.add("by_component", by_component.limit(0))
        raise ZeroDivisionError
    components, rounds = (runs.read_run(spark, path, "profile", name) for name in ("by_component", "rounds"))
    found = rounds.join(components, "Round").groupBy("Round").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_components"), F.max("best").alias("best"))
    return found.withColumn("n_rows", F.lit(runs.run_info(spark, path, "profile")["n_rows"]))


_SCORES = "count(*) FILTER (regexp_matches({c}, '^R[234]\\s*[-_ ]?\\s*0*\\d+', 'i')) AS r, count(*) FILTER (regexp_matches({c}, '^\\d+(\\.0+)?$')) AS i"


def _score_sql(name: str, expression: str) -> str:
    return f"SELECT '{name}' AS column_name, r AS round_hits, i AS integer_hits, r * 10 + least(i, 40) AS score FROM (SELECT {_SCORES.format(c=expression)} FROM f)"


@query(
    "detect_id_column",
    f"WITH {FORMULATIONS} " + " UNION ALL ".join(_score_sql(n, f"CAST({n} AS VARCHAR)") for n in ("candidate_id", "IL1", "order_key", "IL1_molpct")),
)
def detect_id_column(spark, sf_dir):
    return schema.id_column_scores(formulations(spark, sf_dir).select("candidate_id", "IL1", "order_key", "IL1_molpct"))


@query(
    "detect_group_column",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows, count(DISTINCT {c}) BETWEEN 2 AND greatest(3, count(*) // 5) AS eligible FROM documents"
        for c in ("text", "lang", "source")
    ),
)
def detect_group_column(spark, sf_dir):
    return schema.group_column_profile(table(spark, sf_dir, "documents"))


@query(
    "vector_columns",
    """SELECT vec_id, 80 AS n_values, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS total, embedding[1]::DOUBLE AS first,
        embedding[64]::DOUBLE AS last, 0.0::DOUBLE AS padded FROM embeddings""",
    ["total"],
)
def vector_columns(spark, sf_dir):
    """Numbered vector columns in shuffled order, found again by header and padded."""
    order = sorted(range(64), key=lambda i: (i * 37) % 64)
    names = {i: f"fp{'_- '[i % 3]}{i}" for i in order}
    wide = table(spark, sf_dir, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(names[i]) for i in order])
    columns = schema.detect_vector_columns(wide.columns)
    vectors = schema.collect_vector(wide, columns, "v", 80)
    total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b)
    return vectors.select(
        "vec_id", F.size("v").alias("n_values"), total.alias("total"), F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(63)).alias("last"),
        F.get("v", F.lit(79)).alias("padded"),
    )


@query(
    "canonical_names",
    """SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'SM102' WHEN 'LARGE' THEN 'CKK-E12' WHEN 'PROMO' THEN NULL ELSE p_type END AS by_vocabulary,
        'B' || substr(p_brand, 7) AS by_table FROM part""",
)
def canonical_names(spark, sf_dir):
    name = F.col("p_type")
    spelled = F.when(name == "SMALL", "SM-102").when(name == "LARGE", "odd name (CCK12)").when(name == "PROMO", " None ").otherwise(name)
    parts = table(spark, sf_dir, "part")
    aliases = parts.select(F.upper("p_brand").alias("alias"), F.concat(F.lit("B"), F.substring("p_brand", 7, 9)).alias("canonical")).distinct()
    named = parts.select("p_partkey", spelled.alias("spelled"), F.concat("p_name", F.lit(" ("), F.lower("p_brand"), F.lit(")")).alias("full_name"))
    named = canonical_names_by_table(named, "full_name", aliases, "by_table")
    return named.select("p_partkey", canonical_name(F.col("spelled")).alias("by_vocabulary"), "by_table")


@query("normalize_tokens", "SELECT p_partkey, regexp_replace(lower(trim(p_name || ' ' || p_brand)), '[^a-z0-9]+', '', 'g') AS token FROM part")
def normalize_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", normalize_token(F.concat_ws(" ", "p_name", "p_brand")).alias("token"))


_MENTIONS = "list_transform(regexp_extract_all(candidate_id, '(?i)R\\s*(\\d+)', 1), lambda x: x::INT)"
_EXPLICIT = "CASE WHEN order_key % 3 = 0 THEN NULL ELSE 'r ' || substr(Round, 2) END"


@query(
    "round_labels",
    f"""WITH {FORMULATIONS} SELECT sample_id, 'R' || list_max({_MENTIONS}) AS highest, Round AS prefix,
        'R' || list_max({_MENTIONS}) AS later, CASE WHEN order_key % 3 = 0 THEN 'R' || list_max({_MENTIONS}) ELSE Round END AS explicit_first FROM f""",
)
def round_labels(spark, sf_dir):
    explicit = F.when(F.col("order_key") % 3 != 0, F.concat(F.lit("r "), F.substring("Round", 2, 9)))
    highest = round_from_id(F.col("candidate_id"))
    return formulations(spark, sf_dir).select(
        "sample_id",
        highest.alias("highest"),
        round_from_id(F.col("candidate_id"), prefix_only=True).alias("prefix"),
        resolve_round(explicit, highest).alias("later"),
        resolve_round(explicit, highest, later=False).alias("explicit_first"),
    )


@query("multi_round_rows", f"WITH {FORMULATIONS} SELECT sample_id, candidate_id FROM f WHERE len({_MENTIONS}) > 1")
def multi_round_rows(spark, sf_dir):
    return identity.multi_round_rows(formulations(spark, sf_dir)).select("sample_id", "candidate_id")


@query("round_counts", f"WITH {FORMULATIONS} SELECT 'R' || list_max({_MENTIONS}) AS Round, count(*) AS n_rows FROM f GROUP BY ALL")
def round_counts(spark, sf_dir):
    return identity.round_counts(identity.fill_rounds(formulations(spark, sf_dir)))


SIGNATURE_SQL = """concat_ws('|',
  array_to_string(list_transform(list_sort(list_filter([{'n': coalesce(IL1, 'NONE'), 'p': round(IL1_molpct, 4)},
    {'n': coalesce(IL2, 'NONE'), 'p': round(IL2_molpct, 4)}], lambda x: x.n <> 'NONE' OR abs(x.p) > 0)), lambda x: printf('IL:%s:%.4f', x.n, x.p)), '|'),
  printf('HL:%s:%.4f', coalesce(Phospholipid, 'NONE'), round(HL_molpct, 4)), printf('CHOL:%.4f', round(CHOL_molpct, 4)),
  printf('PEG:%s:%.4f', coalesce(PEG, 'NONE'), round(PEG_molpct, 4)), CASE WHEN NP_ratio IS NOT NULL THEN printf('NP:%.4f', round(NP_ratio, 4)) END)"""


@query("signatures", f"WITH {FORMULATIONS} SELECT sample_id, {SIGNATURE_SQL} AS formulation_signature, md5({SIGNATURE_SQL}) AS group_key FROM f")
def signatures(spark, sf_dir):
    return identity.add_signature(formulations(spark, sf_dir)).select("sample_id", "formulation_signature", "group_key")


# Coarse mixtures from the part table, where replicates are common.
_PART_MIXTURE = """SELECT *, concat_ws('|', printf('IL:%s:%.4f', p_name, CAST(p_size % 5 AS DOUBLE)), printf('HL:%s:%.4f', p_type, 0.0::DOUBLE), 'CHOL:0.0000', 'PEG:NONE:0.0000') AS formulation_signature
  FROM part"""


def _part_mixtures(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("IL1"), (F.col("p_size") % 5).cast("double").alias("IL1_molpct"), F.lit(None).cast("string").alias("IL2"),
        F.lit(0.0).alias("IL2_molpct"), F.col("p_type").alias("Phospholipid"), F.lit(0.0).alias("HL_molpct"), F.lit(0.0).alias("CHOL_molpct"),
        F.lit(None).cast("string").alias("PEG"), F.lit(0.0).alias("PEG_molpct"), F.lit(None).cast("double").alias("NP_ratio"),
    )


@query(
    "assigned_groups",
    f"""SELECT p_partkey, md5(formulation_signature) AS group_key, dense_rank() OVER (ORDER BY formulation_signature) - 1 AS formulation_group FROM ({_PART_MIXTURE})""",
)
def assigned_groups(spark, sf_dir):
    return identity.assign_groups(_part_mixtures(spark, sf_dir)).select("p_partkey", "group_key", "formulation_group")


@query(
    "duplicate_groups",
    f"""SELECT count(*) AS n_groups, count(*) FILTER (n > 1) AS duplicate_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_in_duplicate_groups
        FROM (SELECT formulation_signature, count(*) AS n FROM ({_PART_MIXTURE}) GROUP BY 1)""",
)
def duplicate_groups(spark, sf_dir):
    return identity.duplicate_summary(identity.group_sizes(identity.add_signature(_part_mixtures(spark, sf_dir))))


@query(
    "replicate_profile",
    f"WITH {FORMULATIONS} SELECT order_key, count(*) AS n, avg(TE) AS mean, stddev_samp(TE) AS sd, count(DISTINCT Round) AS n_rounds FROM f GROUP BY 1",
    ["mean", "sd"],
)
def replicate_profile(spark, sf_dir):
    return identity.replicate_profile(formulations(spark, sf_dir), "order_key", "TE", "Round")


@query(
    "dedup_first",
    f"WITH {FORMULATIONS} SELECT order_key, sample_id, IL1, IL1_molpct FROM f QUALIFY row_number() OVER (PARTITION BY order_key ORDER BY sample_id) = 1",
)
def dedup_first(spark, sf_dir):
    rows = formulations(spark, sf_dir).select("order_key", "sample_id", "IL1", "IL1_molpct")
    return identity.dedup_keep_first(rows, ["order_key"], ["sample_id"])


_POOL_KEY = "IL1 || '|' || CAST(IL1_molpct AS INT) || '|' || CAST(particle_size AS INT)"


@query(
    "exclude_known",
    f"""WITH {FORMULATIONS}, k AS (SELECT *, {_POOL_KEY} AS pool_key FROM f) SELECT pool_key, sample_id FROM k WHERE Round IN ('R5', 'R6', 'R7')
        AND pool_key NOT IN (SELECT pool_key FROM k WHERE Round NOT IN ('R5', 'R6', 'R7')) QUALIFY row_number() OVER (PARTITION BY pool_key ORDER BY sample_id) = 1""",
)
def exclude_known(spark, sf_dir):
    key = F.concat_ws("|", "IL1", F.col("IL1_molpct").cast("int"), F.col("particle_size").cast("int"))
    rows = formulations(spark, sf_dir).select("sample_id", "Round", key.alias("pool_key"))
    late = F.col("Round").isin("R5", "R6", "R7")
    fresh = identity.exclude_known(rows.where(late), rows.where(~late), "pool_key", ["sample_id"])
    return fresh.select("pool_key", "sample_id")


@query(
    "match_keys",
    f"""WITH {FORMULATIONS} SELECT sample_id, lower(IL1) || '|' || lower(coalesce(IL2, '')) || '|' || lower(Phospholipid) || '|' || lower(PEG) || '|' ||
        printf('%.4f|%.4f|%.4f|%.4f|%.4f|', IL1_molpct, IL2_molpct, HL_molpct, CHOL_molpct, PEG_molpct) ||
        CASE WHEN NP_ratio IS NULL THEN '' ELSE printf('%.4f', NP_ratio) END AS match_key FROM f""",
)
def match_keys(spark, sf_dir):
    return formulations(spark, sf_dir).select("sample_id", identity.composition_match_key().alias("match_key"))


@query("same_component", f"WITH {FORMULATIONS} SELECT sample_id, coalesce(IL1 = IL2, false) AS same_component FROM f")
def same_component(spark, sf_dir):
    return formulations(spark, sf_dir).select("sample_id", identity.same_component_flag().alias("same_component"))
