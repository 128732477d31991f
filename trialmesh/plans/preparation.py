"""Queries over feature blocks, feature selection and split assignment."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import features, information, selection, splits
from ..runtime import materialize
from .registry import query
from .views import FORMULATIONS, fold_sql, folded, folded_sql, formulations, table, uniform_sql

_CORE_SQL = """IL1_molpct, IL2_molpct, IL1_molpct + IL2_molpct AS IL_total_molpct,
  CASE WHEN IL1_molpct + IL2_molpct > 0 THEN IL1_molpct / (IL1_molpct + IL2_molpct) ELSE 0.0 END AS IL1_fraction_in_IL,
  HL_molpct, CHOL_molpct, PEG_molpct, (IL1_molpct + IL2_molpct) * PEG_molpct / 100.0 AS totalIL_x_PEG, CHOL_molpct * HL_molpct / 100.0 AS CHOL_x_HL,
  IL1_molpct + IL2_molpct + HL_molpct AS ILHL_total,
  CASE WHEN IL1_molpct + IL2_molpct + HL_molpct > 0 THEN HL_molpct / (IL1_molpct + IL2_molpct + HL_molpct) ELSE 0.0 END AS HL_fraction_in_ILHL"""
CORE_NAMES = [
    "IL1_molpct", "IL2_molpct", "IL_total_molpct", "IL1_fraction_in_IL", "HL_molpct", "CHOL_molpct", "PEG_molpct", "totalIL_x_PEG", "CHOL_x_HL",
    "ILHL_total", "HL_fraction_in_ILHL",
]


@query("core_features", f"WITH {FORMULATIONS} SELECT sample_id, {_CORE_SQL} FROM f", CORE_NAMES)
def core_features(spark, sf_dir):
    return features.add_features(formulations(spark, sf_dir).select("sample_id", "IL1_molpct", "IL2_molpct", "HL_molpct", "CHOL_molpct", "PEG_molpct"), features.core_numeric_features())


def _hot_sql(column: str, categories, prefix: str, none: str | None = None) -> str:
    known = ", ".join(f"'{c}'" for c in categories)
    label = f"CASE WHEN {column} IN ({known}) THEN {column} ELSE 'UNKNOWN' END"
    if none:
        label = f"CASE WHEN {column} IS NULL THEN '{none}' ELSE {label} END"
    return ", ".join(f"CASE WHEN {label} = '{c}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"{prefix}_{c}\"" for c in categories)


_SHORT = ["Brand#1", "Brand#2", "Brand#3", "UNKNOWN"]


@query(
    "one_hot",
    f"""WITH {FORMULATIONS} SELECT sample_id, {_hot_sql('IL1', _SHORT, 'IL1')}, {_hot_sql('IL2', ['NONE', *_SHORT], 'IL2', 'NONE')},
        {_hot_sql('Phospholipid', ['A', 'N', 'UNKNOWN'], 'Phospholipid')}, {_hot_sql('PEG', ['F', 'O', 'UNKNOWN'], 'PEG')} FROM f""",
)
def one_hot(spark, sf_dir):
    blocks = (
        features.one_hot_fixed("IL1", _SHORT, "IL1")
        | features.one_hot_fixed("IL2", ["NONE", *_SHORT], "IL2", none_label="NONE")
        | features.one_hot_fixed("Phospholipid", ["A", "N", "UNKNOWN"], "Phospholipid")
        | features.one_hot_fixed("PEG", ["F", "O", "UNKNOWN"], "PEG")
    )
    return formulations(spark, sf_dir).select("sample_id", *[column.alias(name) for name, column in blocks.items()])


_DESCRIPTORS_SQL = "d AS (SELECT p_brand AS component, avg(p_size) AS carbons, avg(p_retailprice) AS bonds FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY 1)"


def _brand_descriptors(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where(~F.col("p_brand").isin("Brand#1", "Brand#2"))
    return parts.groupBy(F.col("p_brand").alias("component")).agg(F.avg("p_size").alias("carbons"), F.avg("p_retailprice").alias("bonds"))


@query(
    "weighted_descriptors",
    f"""WITH {FORMULATIONS}, {_DESCRIPTORS_SQL}, w AS (SELECT sample_id, a.carbons AS c1, a.bonds AS b1, b.carbons AS c2, b.bonds AS b2,
          CASE WHEN a.component IS NOT NULL AND IL1_molpct > 0 THEN IL1_molpct ELSE 0.0 END AS w1,
          CASE WHEN b.component IS NOT NULL AND IL2_molpct > 0 THEN IL2_molpct ELSE 0.0 END AS w2
          FROM f LEFT JOIN d a ON a.component = IL1 LEFT JOIN d b ON b.component = IL2),
        m AS (SELECT sample_id, CASE WHEN w1 + w2 > 0 THEN (coalesce(c1, 0) * w1 + coalesce(c2, 0) * w2) / (w1 + w2) ELSE 0.0 END AS c,
          CASE WHEN w1 + w2 > 0 THEN (coalesce(b1, 0) * w1 + coalesce(b2, 0) * w2) / (w1 + w2) ELSE 0.0 END AS b FROM w)
        SELECT sample_id, c AS ILdesc_carbons, b AS ILdesc_bonds, CASE WHEN c > 0 THEN b / c ELSE 0.0 END AS ILdesc_unsaturation_density FROM m""",
    ["ILdesc_carbons", "ILdesc_bonds", "ILdesc_unsaturation_density"],
)
def weighted_descriptors(spark, sf_dir):
    rows = formulations(spark, sf_dir).select("sample_id", "IL1", "IL1_molpct", "IL2", "IL2_molpct")
    names = ["carbons", "bonds"]
    mixed = features.weighted_descriptor_features(rows, _brand_descriptors(spark, sf_dir), names, unsaturation=("bonds", "carbons"))
    return mixed.select("sample_id", "ILdesc_carbons", "ILdesc_bonds", "ILdesc_unsaturation_density")


def _label_vectors(spark, sf_dir):
    """Mean embedding per label, as the vector of the component with that number."""
    values = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = values.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    # One short vector per label: at most as many entries as the embedding is long.
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))
    return vectors.select(F.concat(F.lit("Brand#"), (F.col("label") + 1).cast("string")).alias("component"), F.col("p.v").alias("vector"))


_VECTORS_SQL = """v AS (SELECT 'Brand#' || (label + 1) AS component, i, avg(x::DOUBLE) AS x
  FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i)"""
_PAIR_VECTOR_SQL = f"""WITH {FORMULATIONS}, {_VECTORS_SQL}, k AS (SELECT DISTINCT component FROM v),
  c AS (SELECT component, sum(x) AS total, max(x) FILTER (i = 1) AS first FROM v GROUP BY 1)"""


@query(
    "weighted_vectors",
    f"""{_PAIR_VECTOR_SQL}, w AS (SELECT sample_id, a.total AS t1, a.first AS f1, b.total AS t2, b.first AS f2,
          CASE WHEN a.component IS NOT NULL AND IL1_molpct > 0 THEN IL1_molpct ELSE 0.0 END AS w1,
          CASE WHEN b.component IS NOT NULL AND IL2_molpct > 0 THEN IL2_molpct ELSE 0.0 END AS w2
          FROM f LEFT JOIN c a ON a.component = IL1 LEFT JOIN c b ON b.component = IL2)
        SELECT sample_id, 64 AS n_values, coalesce((coalesce(t1, 0) * w1 + coalesce(t2, 0) * w2) / nullif(w1 + w2, 0), 0) AS total,
          coalesce((coalesce(f1, 0) * w1 + coalesce(f2, 0) * w2) / nullif(w1 + w2, 0), 0) AS first FROM w""",
    ["total", "first"],
)
def weighted_vectors(spark, sf_dir):
    rows = formulations(spark, sf_dir).select("sample_id", "IL1", "IL1_molpct", "IL2", "IL2_molpct")
    return _vector_summary(features.weighted_vector_features(rows, _label_vectors(spark, sf_dir), 64))


def _vector_summary(df):
    total = F.aggregate("vector", F.lit(0.0), lambda a, b: a + b)
    return df.select("sample_id", F.size("vector").alias("n_values"), total.alias("total"), F.get("vector", F.lit(0)).alias("first"))


@query(
    "shared_vectors",
    f"""{_PAIR_VECTOR_SQL}, w AS (SELECT sample_id, coalesce(a.total, 0) AS t1, coalesce(a.first, 0) AS f1, coalesce(b.total, a.total, 0) AS t2,
          coalesce(b.first, a.first, 0) AS f2, CASE WHEN IL1_molpct + IL2_molpct > 0 THEN IL1_molpct / (IL1_molpct + IL2_molpct) ELSE 0.5 END AS s
          FROM f LEFT JOIN c a ON a.component = IL1 LEFT JOIN c b ON b.component = IL2)
        SELECT sample_id, 70 AS n_values, t1 * s + t2 * (1 - s) AS total, f1 * s + f2 * (1 - s) AS first FROM w""",
    ["total", "first"],
)
def shared_vectors(spark, sf_dir):
    rows = formulations(spark, sf_dir).select("sample_id", "IL1", "IL1_molpct", "IL2", "IL2_molpct")
    return _vector_summary(features.shared_vector_features(rows, _label_vectors(spark, sf_dir), 70))


@query(
    "assembled_features",
    f"WITH {FORMULATIONS} SELECT sample_id, 5 AS n_features, IL1_molpct + HL_molpct + particle_size + coalesce(NP_ratio, 0) AS total FROM f",
    ["total"],
)
def assembled_features(spark, sf_dir):
    rows = features.assemble(formulations(spark, sf_dir), ["IL1_molpct", "HL_molpct", "particle_size"], ["NP_ratio", "absent_feature"])
    vector = vector_to_array("features")
    return rows.select("sample_id", F.size(vector).alias("n_features"), F.aggregate(vector, F.lit(0.0), lambda a, b: a + b).alias("total"))


_EARLY = ", ".join(f"avg({c}) FILTER (Round IN ('R1', 'R2', 'R3')) AS m_{c}, stddev_pop({c}) FILTER (Round IN ('R1', 'R2', 'R3')) AS s_{c}" for c in ("TE", "IL1_molpct", "price"))


@query(
    "standardized_features",
    f"WITH {FORMULATIONS}, s AS (SELECT {_EARLY} FROM f) SELECT sample_id, "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in ("TE", "IL1_molpct", "price"))
    + " FROM f, s",
    ["TE", "IL1_molpct", "price"],
)
def standardized_features(spark, sf_dir):
    rows = formulations(spark, sf_dir).select("sample_id", "Round", "TE", "IL1_molpct", "price")
    scaler = features.Standardizer.fit(rows.where(F.col("Round").isin("R1", "R2", "R3")), ["TE", "IL1_molpct", "price"])
    return scaler.transform(rows).drop("Round")


@query(
    "minmax_scaled",
    f"""WITH {FORMULATIONS} SELECT sample_id, (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) AS price01, 0.0::DOUBLE AS constant01 FROM f""",
    ["price01"],
)
def minmax_scaled(spark, sf_dir):
    rows = formulations(spark, sf_dir).select("sample_id", "price").withColumn("constant", F.lit(3.0))
    return features.minmax01(features.minmax01(rows, "price", "price01"), "constant", "constant01").drop("price", "constant")


_NUMBERS = ["IL1_molpct", "IL2_molpct", "HL_molpct", "CHOL_molpct", "PEG_molpct", "NP_ratio"]
_NAMES = ["IL1", "IL2", "Phospholipid", "PEG"]
_FILLED = ", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in _NUMBERS)
_SHARES = ", ".join(f"count(*) OVER (PARTITION BY {c}) / count(*) OVER () AS p_{c}" for c in _NAMES)
# For one row and one name column: z of its own category squared, plus p/(1-p) of every other category.
_ODDS = ", ".join(f"(SELECT sum(p / (1 - p)) FROM (SELECT count(*) / (SELECT count(*) FROM n0) AS p FROM n0 GROUP BY {c})) AS o_{c}" for c in _NAMES)


@query(
    "diversity_matrix",
    f"""WITH {FORMULATIONS}, n0 AS (SELECT sample_id, {_FILLED}, {', '.join(f"coalesce({c}, '') AS {c}" for c in _NAMES)} FROM f),
        n1 AS (SELECT *, {_SHARES} FROM n0), o AS (SELECT {_ODDS}),
        z AS (SELECT sample_id, {', '.join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}' for c in _NUMBERS)},
          {' + '.join(f'o_{c} - p_{c} / (1 - p_{c}) + (1 - p_{c}) / p_{c}' for c in _NAMES)} AS names FROM n1, o)
        SELECT sample_id, IL1_molpct AS z_first, NP_ratio AS z_ratio, {' + '.join(f'{c} * {c}' for c in _NUMBERS)} + names AS norm_sq FROM z""",
    ["z_first", "z_ratio", "norm_sq"],
)
def diversity_matrix(spark, sf_dir):
    rows = materialize(formulations(spark, sf_dir).select("sample_id", *_NUMBERS, *_NAMES))
    vectors, _ = features.diversity_matrix(rows, "sample_id", _NUMBERS, _NAMES, stable=True)
    norm = F.aggregate("z", F.lit(0.0), lambda a, b: a + b * b)
    return vectors.select("sample_id", F.get("z", F.lit(0)).alias("z_first"), F.get("z", F.lit(5)).alias("z_ratio"), norm.alias("norm_sq"))


@query(
    "within_group_percentile",
    """SELECT event_id, (rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0)
        / count(*) OVER (PARTITION BY event_type) AS percentile FROM events""",
    ["percentile"],
)
def within_group_percentile(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return splits.within_group_percentile(rows, "value", "event_type", "event_id", stable=True).select("event_id", "percentile")


_SELECTABLE = ["IL1_molpct", "IL2_molpct", "HL_molpct", "CHOL_molpct", "PEG_molpct", "particle_size", "only_fold_one", "constant", "is_dual", "noise"]


def _selectable(spark, sf_dir):
    """Features with a constant one and one that varies in a single fold."""
    rows = folded(spark, sf_dir)
    return rows.withColumns(
        {
            "only_fold_one": F.when(F.col("fold_id") == 1, F.col("IL1_molpct")).otherwise(F.lit(2.0)),
            "constant": F.lit(0.3),
            "is_dual": F.col("IL2").isNotNull().cast("double"),
            "noise": F.col("order_key") % 97 * 1.0,
        }
    ).select("sample_id", "order_key", "fold_id", "TE", *_SELECTABLE)


_SELECTABLE_SQL = f"""{folded_sql()}, s AS (SELECT sample_id, fold_id, TE, IL1_molpct, IL2_molpct, HL_molpct, CHOL_molpct, PEG_molpct, particle_size,
  CASE WHEN fold_id = 1 THEN IL1_molpct ELSE 2.0 END AS only_fold_one, 0.3::DOUBLE AS "constant", (IL2 IS NOT NULL)::INT::DOUBLE AS is_dual,
  (order_key % 97)::DOUBLE AS noise FROM folded),
  k AS (SELECT unnest(range(1, 6))::INT AS fold_id)"""
_LONG_SQL = f"long AS (UNPIVOT (SELECT * FROM s) ON {', '.join(_SELECTABLE)} INTO NAME feature VALUE value)"


@query(
    "constant_features",
    f"""WITH {_SELECTABLE_SQL}, {_LONG_SQL} SELECT k.fold_id, feature, min(value) AS train_min, max(value) AS train_max, max(value) - min(value) <= 1e-12 AS is_constant
        FROM k JOIN long ON long.fold_id <> k.fold_id GROUP BY ALL""",
)
def constant_features(spark, sf_dir):
    return selection.constant_features(_selectable(spark, sf_dir), _SELECTABLE)


@query(
    "binned_mutual_information",
    f"""WITH {_SELECTABLE_SQL}, {_LONG_SQL},
        e AS (SELECT feature, unnest(list_distinct(quantile_cont(value, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]))) AS edge FROM long GROUP BY feature),
        y AS (SELECT unnest(list_distinct(quantile_cont(TE, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]))) AS edge FROM s),
        yb AS (SELECT sample_id, count(y.edge) AS yb FROM s LEFT JOIN y ON s.TE > y.edge GROUP BY 1),
        el AS (SELECT feature, list_sort(list(edge)) AS edges FROM e GROUP BY 1),
        b AS (SELECT long.fold_id, long.sample_id, feature, len(list_filter(edges, lambda q: q < value)) AS xb FROM long JOIN el USING (feature)),
        c AS (SELECT k.fold_id, feature, xb, yb, count(*) AS n FROM k JOIN b ON b.fold_id <> k.fold_id JOIN yb USING (sample_id) GROUP BY ALL),
        w AS (SELECT *, sum(n) OVER (PARTITION BY fold_id, feature, xb) AS nx, sum(n) OVER (PARTITION BY fold_id, feature, yb) AS ny,
              sum(n) OVER (PARTITION BY fold_id, feature) AS nn FROM c)
        SELECT fold_id, feature, greatest(sum(n / nn * ln(n::DOUBLE * nn::DOUBLE / (nx::DOUBLE * ny::DOUBLE))), 0.0) AS relevance FROM w GROUP BY ALL""",
    ["relevance"],
)
def binned_mutual_information(spark, sf_dir):
    return selection.binned_mutual_information(materialize(_selectable(spark, sf_dir)), _SELECTABLE, "TE", "sample_id", stable=True)


_PAIRS_SQL = " UNION ALL ".join(
    f"""SELECT k.fold_id, '{a}' AS feature_a, '{b}' AS feature_b, CASE WHEN max({a}) - min({a}) > 1e-9 AND max({b}) - min({b}) > 1e-9
        THEN abs(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)) ELSE 0.0 END AS abs_correlation
        FROM k JOIN s ON s.fold_id <> k.fold_id GROUP BY k.fold_id"""
    for i, a in enumerate(_SELECTABLE)
    for b in _SELECTABLE[i + 1 :]
).replace('constant)', '"constant")').replace("(constant", '("constant"')


@query("pairwise_correlation", f"WITH {_SELECTABLE_SQL} {_PAIRS_SQL}", ["abs_correlation"])
def pairwise_correlation(spark, sf_dir):
    return selection.pairwise_abs_correlation(_selectable(spark, sf_dir), _SELECTABLE)


@query("mrmr_selection")
def mrmr_selection(spark, sf_dir):
    return selection.mrmr_select(materialize(_selectable(spark, sf_dir)), _SELECTABLE, "TE", "sample_id", k=4, stable=True)


_NEAR = [*[f"e{i}" for i in range(4)], "coarse"]


def _near_rows(spark, sf_dir):
    """Four components of an embedding and one rounded to three values, with a target that depends on two of them."""
    part = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("key"), (F.col("vec_id") % 3 + 1).cast("int").alias("fold_id"), *[part(i).alias(f"e{i}") for i in range(4)],
        F.signum(F.round(part(1) * 5)).alias("coarse"), (part(0) + 0.5 * part(1) * part(1) + 0.1 * part(4)).alias("t"),
    )
    return materialize(rows)


_NEAR_SQL = f"""rows_ AS (SELECT vec_id::VARCHAR AS key, (vec_id % 3 + 1)::INT AS fold_id, {', '.join(f'embedding[{i + 1}]::DOUBLE AS e{i}' for i in range(4))},
          sign(round(embedding[2]::DOUBLE * 5))::DOUBLE AS coarse, embedding[1]::DOUBLE + 0.5::DOUBLE * embedding[2]::DOUBLE * embedding[2]::DOUBLE + 0.1::DOUBLE * embedding[5]::DOUBLE AS t FROM embeddings),
        l AS (SELECT k.k AS train, key, t, feature, v FROM (UNPIVOT rows_ ON {', '.join(_NEAR)} INTO NAME feature VALUE v) r JOIN (SELECT unnest([1, 2, 3])::INT AS k) k ON r.fold_id <> k.k),
        st AS (SELECT train, feature, stddev_pop(v) AS sv, stddev_pop(t) AS st, avg(abs(v)) AS mv, avg(abs(t)) AS mt FROM l GROUP BY ALL),
        p AS (SELECT train, feature, key, v / sv + 1e-10::DOUBLE * greatest(1, mv / sv) * ({uniform_sql("key || '|' || feature || '|x|42'")} - 0.5::DOUBLE) AS x,
            t / st + 1e-10::DOUBLE * greatest(1, mt / st) * ({uniform_sql("key || '|' || feature || '|y|42'")} - 0.5::DOUBLE) AS y FROM l JOIN st USING (train, feature)),
        d AS (SELECT a.train, a.feature, a.key, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, a.key = b.key AS own FROM p a JOIN p b USING (train, feature)),
        r AS (SELECT train, feature, key, max(d) AS r FROM (SELECT *, greatest(dx, dy) AS d FROM d WHERE NOT own QUALIFY row_number() OVER (PARTITION BY train, feature, key ORDER BY greatest(dx, dy)) <= 3) GROUP BY ALL),
        c AS (SELECT train, feature, key, count(*) FILTER (dx < r * (1 - 1e-13::DOUBLE)) AS nx, count(*) FILTER (dy < r * (1 - 1e-13::DOUBLE)) AS ny FROM d JOIN r USING (train, feature, key) GROUP BY ALL),
        h AS (SELECT i AS n, coalesce(sum(1.0::DOUBLE / nullif(i - 1, 0)) OVER (ORDER BY i), 0) - 0.5772156649015329::DOUBLE AS psi FROM (SELECT unnest(range(1, (SELECT count(*) FROM embeddings) + 2)) AS i)),
        m AS (SELECT train, feature, count(*) AS n, avg(hx.psi + hy.psi) AS s FROM c JOIN h hx ON hx.n = nx JOIN h hy ON hy.n = ny GROUP BY ALL)"""


@query(
    "neighbour_mutual_information",
    f"WITH {_NEAR_SQL} SELECT train AS fold_id, feature, greatest(hn.psi + hk.psi - s, 0) AS relevance FROM m JOIN h hn ON hn.n = m.n JOIN h hk ON hk.n = 3",
    ["relevance"],
)
def neighbour_mutual_information(spark, sf_dir):
    return information.neighbour_mutual_information(_near_rows(spark, sf_dir), _NEAR, "t", "key", cell_rows=100)


@query(
    "mrmr_neighbours",
    f"""WITH RECURSIVE {_NEAR_SQL}, mi AS (SELECT train, feature, round(greatest(hn.psi + hk.psi - s, 0), 9) AS relevance FROM m JOIN h hn ON hn.n = m.n JOIN h hk ON hk.n = 3),
        co AS (SELECT a.train, a.feature AS fa, b.feature AS fb, abs(corr(a.v, b.v)) AS c FROM l a JOIN l b USING (train, key) GROUP BY ALL),
        pick AS (SELECT train, 1 AS step, [arg_max(feature, relevance)] AS chosen FROM mi GROUP BY train
          UNION ALL SELECT train, step + 1, list_append(chosen, (SELECT mi.feature FROM mi WHERE mi.train = pick.train AND NOT list_contains(chosen, mi.feature)
            ORDER BY relevance - (SELECT avg(c) FROM co WHERE co.train = pick.train AND fa = mi.feature AND list_contains(chosen, fb)) DESC LIMIT 1)) FROM pick WHERE step < 3)
        SELECT train AS fold_id, unnest(range(1, 4))::INT AS aux_rank, unnest(chosen) AS feature FROM pick WHERE step = 3""",
)
def mrmr_neighbours(spark, sf_dir):
    """Greedy selection on the neighbour estimate; the oracle repeats the choice from correlations."""
    rows = _near_rows(spark, sf_dir)
    relevance = information.neighbour_mutual_information(rows, _NEAR, "t", "key")
    return selection.mrmr_select(rows, _NEAR, "t", "key", k=3, stable=True, relevance_of=relevance)


_CHOSEN_SQL = f"""{FORMULATIONS}, m AS (SELECT Phospholipid AS model, Round AS fold, IL1 AS feature, round(avg(TE), 9) AS y FROM f GROUP BY ALL),
  chosen AS (SELECT model, fold, feature, row_number() OVER (PARTITION BY model, fold ORDER BY y DESC, feature) AS aux_rank FROM m QUALIFY aux_rank <= 8)"""


@query(
    "selection_frequency",
    f"WITH {_CHOSEN_SQL} SELECT model, feature, count(*) AS selection_count, count(*) / 7.0::DOUBLE AS selection_fraction, avg(aux_rank) AS mean_rank FROM chosen GROUP BY ALL",
    ["selection_fraction", "mean_rank"],
)
def selection_frequency(spark, sf_dir):
    """Components as features: the eight with the best mean response per helper (model) and round (fold)."""
    from pyspark.sql import Window

    means = formulations(spark, sf_dir).groupBy(F.col("Phospholipid").alias("model"), F.col("Round").alias("fold"), F.col("IL1").alias("feature"))
    means = means.agg(F.round(F.avg("TE"), 9).alias("y"))
    place = F.row_number().over(Window.partitionBy("model", "fold").orderBy(F.desc("y"), "feature"))
    return selection.selection_frequency(means.withColumn("aux_rank", place).where("aux_rank <= 8"), 7)


@query(
    "grouped_folds",
    f"""WITH {FORMULATIONS}, r AS (SELECT unnest([1, 2, 3]) AS repeat_id), g AS (SELECT DISTINCT order_key FROM f),
        a AS (SELECT order_key, repeat_id, ntile(5) OVER (PARTITION BY repeat_id ORDER BY md5(order_key || '|7|' || repeat_id))::INT AS fold_id FROM g, r)
        SELECT sample_id, repeat_id, fold_id FROM f JOIN a USING (order_key)""",
)
def grouped_folds(spark, sf_dir):
    rows = formulations(spark, sf_dir).select("sample_id", "order_key")
    return splits.grouped_kfold(rows, "order_key", k=5, repeats=3, seed=7).drop("order_key")


@query(
    "random_folds",
    """SELECT event_id, repeat_id, ntile(4) OVER (PARTITION BY repeat_id ORDER BY md5(event_id || '|7|' || repeat_id))::INT AS fold_id
        FROM events, (SELECT unnest([1, 2]) AS repeat_id)""",
)
def random_folds(spark, sf_dir):
    return splits.random_kfold(table(spark, sf_dir, "events").select("event_id"), "event_id", k=4, repeats=2, seed=7)


@query(
    "cumulative_stages",
    f"""WITH {FORMULATIONS}, s AS (SELECT DISTINCT CAST(substr(Round, 2) AS INT) AS r FROM f), st AS (SELECT row_number() OVER (ORDER BY r)::INT AS stage_order, r FROM s)
      SELECT stage_order, (SELECT string_agg('R' || b.r, '+' ORDER BY b.r) FROM st b WHERE b.r <= st.r) AS stage, count(*) AS n_rows, count(DISTINCT order_key) AS n_groups
      FROM st JOIN f ON CAST(substr(f.Round, 2) AS INT) <= st.r GROUP BY stage_order, st.r""",
)
def cumulative_stages(spark, sf_dir):
    staged = splits.cumulative_stages(formulations(spark, sf_dir).select("order_key", "Round"), "Round")
    return staged.groupBy("stage_order", "stage").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("order_key").alias("n_groups"))


@query(
    "leave_one_round_out",
    f"""WITH {FORMULATIONS}, t AS (SELECT DISTINCT Round AS test_round FROM f)
        SELECT test_round, CASE WHEN Round = test_round THEN 'test' ELSE 'train' END AS role, count(*) AS n_rows FROM f, t GROUP BY ALL""",
)
def leave_one_round_out(spark, sf_dir):
    roles = splits.leave_one_round_out(formulations(spark, sf_dir).select("sample_id", "Round"), "Round")
    return roles.groupBy("test_round", "role").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "support_query",
    """SELECT event_id, repeat_id, CASE WHEN row_number() OVER (PARTITION BY repeat_id ORDER BY md5(event_id || '|5|' || repeat_id))
          <= greatest(3, least(round_even(count(*) OVER (PARTITION BY repeat_id) * 0.8::DOUBLE, 0), count(*) OVER (PARTITION BY repeat_id) - 2)) THEN 'support' ELSE 'query' END AS role
        FROM events, (SELECT unnest([0, 1, 2]) AS repeat_id)""",
)
def support_query(spark, sf_dir):
    return splits.random_support_query(table(spark, sf_dir, "events").select("event_id"), "event_id", 0.8, repeats=3, seed=5)


@query("latest_round_query", f"WITH {FORMULATIONS} SELECT sample_id, CASE WHEN Round = 'R7' THEN 'query' ELSE 'support' END AS role FROM f")
def latest_round_query(spark, sf_dir):
    return splits.latest_round_query(formulations(spark, sf_dir).select("sample_id", "Round"), "Round").select("sample_id", "role")


@query("listed_rounds_query", f"WITH {FORMULATIONS} SELECT sample_id, CASE WHEN Round = 'R4' THEN 'query' ELSE 'support' END AS role FROM f WHERE Round IN ('R1', 'R2', 'R4')")
def listed_rounds_query(spark, sf_dir):
    rows = formulations(spark, sf_dir).select("sample_id", "Round")
    return splits.latest_round_query(rows, "Round", ["1", "R2"], ["R4"]).select("sample_id", "role")


_TASKS_SQL = """p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(event_id || '|42')) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
  tasks AS (SELECT event_id, value, user_id || printf('__chunk%03d', pos // 20) AS task_id FROM p WHERE pos // 20 < n // 20)"""


def _tasks(spark, sf_dir):
    return splits.chunk_tasks(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "event_id", 20, stable=True)


@query("task_chunks", f"WITH {_TASKS_SQL} SELECT event_id, task_id FROM tasks")
def task_chunks(spark, sf_dir):
    return _tasks(spark, sf_dir).select("event_id", "task_id")


@query("task_report", f"WITH {_TASKS_SQL} SELECT (SELECT count(*) FROM events) AS n_rows_before, count(*) AS n_rows_after, count(DISTINCT task_id) AS n_tasks FROM tasks")
def task_report(spark, sf_dir):
    return splits.chunk_report(table(spark, sf_dir, "events"), _tasks(spark, sf_dir))


@query(
    "alternate_tasks",
    f"""WITH {_TASKS_SQL} SELECT event_id, task_id, CASE WHEN row_number() OVER (PARTITION BY task_id ORDER BY value, event_id) % 2 = 1 THEN 'support' ELSE 'query' END AS role FROM tasks""",
)
def alternate_tasks(spark, sf_dir):
    return splits.alternate_by_response(_tasks(spark, sf_dir), "value", "event_id").select("event_id", "task_id", "role")


_ASSIGNED_SQL = f"""r AS (SELECT unnest([1, 2]) AS repeat_id), t AS (SELECT event_id, user_id, repeat_id::INT AS repeat_id, {fold_sql("md5(user_id || '|3|' || repeat_id)", 3)} AS test_fold FROM events, r),
  a AS (SELECT event_id, user_id, repeat_id, fold_id::INT AS fold_id, ((repeat_id - 1) * 3 + fold_id)::INT AS global_fold_id, CASE WHEN fold_id = test_fold THEN 'test' ELSE 'train' END AS role
        FROM t, (SELECT unnest([1, 2, 3]) AS fold_id))"""


def _assigned(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return splits.split_assignments(splits.grouped_kfold(rows, "user_id", k=3, repeats=2, seed=3, exact=False), 3)


@query("split_assignments", f"WITH {_ASSIGNED_SQL} SELECT * FROM a")
def split_assignments(spark, sf_dir):
    return _assigned(spark, sf_dir)


@query("split_coverage", f"WITH {_ASSIGNED_SQL} SELECT repeat_id, count(DISTINCT event_id) AS n_samples, 0::BIGINT AS n_not_tested_once FROM a GROUP BY 1")
def split_coverage(spark, sf_dir):
    return splits.split_coverage(_assigned(spark, sf_dir), "event_id")


@query(
    "split_leakage",
    f"WITH {_ASSIGNED_SQL} SELECT repeat_id, fold_id, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, 0::BIGINT AS n_leaking_groups FROM a GROUP BY ALL",
)
def split_leakage(spark, sf_dir):
    return splits.split_leakage(_assigned(spark, sf_dir), "user_id")
