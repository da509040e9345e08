"""Registered queries (one per operator family) and their SQL twins.

Standard parameters: English -> German pairs, k = 4 demonstrations, seed 42.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icx import oracle as sql
from icx.operators import demos as D
from icx.operators import prompts as P
from icx.sources import tables
from icx.sources.index import dense_index

SRC, TGT, AUX = "eng_Latn", "deu_Latn", "fra_Latn"
K, SEED = 4, 42

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def _split(df: DataFrame, which: str) -> DataFrame:
    return df.filter(F.col("split") == which).drop("split")


def _test_dev(spark, sf_dir):
    p = tables.pairs(spark, sf_dir)
    scan = tables.read(spark, sf_dir, "conversations")
    return tables.spread(_split(p, "test"), "row_id", basis=scan), _split(p, "dev")


TEST_SQL = f"SELECT row_id, src, tgt FROM ({sql.PAIRS}) WHERE split = 'test'"
DEV_SQL = f"SELECT row_id, src, tgt FROM ({sql.PAIRS}) WHERE split = 'dev'"
AUX_DEV_SQL = f"SELECT row_id, src, tgt FROM ({sql.AUX_PAIRS}) WHERE split = 'dev'"


# ---- sources ----------------------------------------------------------------------------

@register("dense_index", f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS idx, row_id, src, tgt FROM ({DEV_SQL})")
def q_dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dev = _test_dev(spark, sf_dir)
    idx = dense_index(dev, ["row_id"]).df
    return idx.select("idx", "row_id", "src", "tgt")


# ---- demonstrations and prompts ----------------------------------------------------------

@register(
    "select_demos",
    sql.demos_cte(TEST_SQL, DEV_SQL, K, SEED) + "\nSELECT row_id, demo_pos, demo_idx, d_src AS src, d_tgt AS tgt FROM demos",
)
def q_select_demos(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, dev = _test_dev(spark, sf_dir)
    pool = D.Pool.build(dev)
    drawn = D.draw(test.select("row_id"), "row_id", pool.size, K, SEED)
    ex = drawn.select("row_id", F.posexplode("demo_idx").alias("demo_pos", "demo_idx"))
    side = pool.df.withColumnRenamed("idx", "demo_idx")
    side = F.broadcast(side) if pool.broadcastable() else side  # measured size, else shuffle join
    return ex.join(side, "demo_idx").select(
        "row_id", "demo_pos", "demo_idx", "src", "tgt"
    )


def _few_shot(spark, sf_dir, kind="standard", chat=False, force=None):
    test, dev = _test_dev(spark, sf_dir)
    with_demos = D.select_demos(test, dev, K, SEED, force=force)
    out = P.few_shot(with_demos, SRC, TGT, chat=chat, kind=kind, seed=SEED)
    if chat:
        return P.messages_long(out, ["row_id"])
    return out.select("row_id", "prompt", F.col("tgt").alias("reference"))


@register("few_shot_prompt", sql.few_shot_text(TEST_SQL, DEV_SQL, K, SEED, SRC, TGT))
def q_few_shot_prompt(spark, sf_dir):
    return _few_shot(spark, sf_dir)


@register("few_shot_prompt_shuffle_join", sql.few_shot_text(TEST_SQL, DEV_SQL, K, SEED, SRC, TGT))
def q_few_shot_prompt_shuffle(spark, sf_dir):
    return _few_shot(spark, sf_dir, force="shuffle")


@register("chat_prompt", sql.few_shot_chat(TEST_SQL, DEV_SQL, K, SEED, SRC, TGT))
def q_chat_prompt(spark, sf_dir):
    return _few_shot(spark, sf_dir, chat=True)


for _kind in P.INSTRUCTION_KINDS:
    _name = "none" if _kind == "no_instruct" else _kind

    def _mk(kind):
        return lambda spark, sf_dir: _few_shot(spark, sf_dir, kind=kind)

    def _mkc(kind):
        return lambda spark, sf_dir: _few_shot(spark, sf_dir, kind=kind, chat=True)

    register(f"instruction_{_name}", sql.few_shot_text(TEST_SQL, DEV_SQL, K, SEED, SRC, TGT, kind=_kind))(_mk(_kind))
    register(f"instruction_{_name}_chat", sql.few_shot_chat(TEST_SQL, DEV_SQL, K, SEED, SRC, TGT, kind=_kind))(
        _mkc(_kind)
    )


# ---- perturbation operators over whole documents ----------------------------------------

from icx.operators import perturb as PT  # noqa: E402

PTB_RATE = 0.25


def _ptb(attack):
    def run(spark, sf_dir):
        ln = tables.lines(spark, sf_dir)
        return ln.select(
            "row_id", PT.perturb(attack, F.col("text"), [F.col("row_id")], F.col("code"), PTB_RATE, SEED).alias("perturbed")
        )

    return run


for _attack in PT.ATTACKS:
    _short = _attack.replace("_attack", "")
    register(f"ptb_{_short}", sql.ptb_sql(_attack, sql.LINES, ["row_id"], PTB_RATE, SEED))(_ptb(_attack))


# ---- pivot study -----------------------------------------------------------------------

from icx.operators import pivot as PV  # noqa: E402

PIVOT = "fra_Latn"  # nominal languages: English -> German (pivot) -> French


@register("pivot_join", sql.TRIPLES)
def q_pivot_join(spark, sf_dir):
    return tables.triples(spark, sf_dir)


def _pivot(variant, chat=False):
    def run(spark, sf_dir):
        out = PV.prompts(tables.triples(spark, sf_dir), SRC, TGT, PIVOT, variant, SEED, chat=chat)
        if chat:
            return P.messages_long(out, PV.ROW_KEYS)
        return out.select(*PV.ROW_KEYS, "prompt")

    return run


for _v in PV.VARIANTS:
    register(f"pivot_variant_{_v}", sql.pivot_text_sql(_v, SEED, SRC, TGT, PIVOT))(_pivot(_v))
register("pivot_chat", sql.pivot_chat_sql("II", SEED, SRC, TGT, PIVOT))(_pivot("II", chat=True))
for _v in ("I", "III", "IV"):
    register(f"pivot_chat_{_v}", sql.pivot_chat_sql(_v, SEED, SRC, TGT, PIVOT))(_pivot(_v, chat=True))


# ---- generation data path, predictions and metrics ------------------------------------------

from icx.operators import generate as G  # noqa: E402
from icx.sources import io as IO  # noqa: E402
from icx.sources import positions as POS  # noqa: E402
from icx.operators import metrics as M  # noqa: E402

RUNS = ("clean",) + PT.ATTACKS
BATCH = 24  # 4-shot batch size


def _prompts(spark, sf_dir):
    test, dev = _test_dev(spark, sf_dir)
    out = P.few_shot(D.select_demos(test, dev, K, SEED), SRC, TGT)
    return out.select("row_id", "prompt", F.col("tgt").alias("reference"))


#: The stand-in model answers no prompt longer than its context.
CONTEXT = 12_000


def _raw(prompt, reference, key, run):
    """Stand-in output of a run: prompt ' ' hyp '\\n' 'extra'; no output beyond the context."""
    hyp = PT.perturb(F.when(run.isin(*PT.ATTACKS), run), reference, [key], TGT, PTB_RATE, SEED)
    return F.when(F.char_length(prompt) <= CONTEXT, G.echo_stand_in(prompt, hyp))


def _predictions(spark, sf_dir):
    """Every prompt under every run, in one pass: the runs are exploded, the texts stay in the row."""
    runs = F.explode(F.array(*[F.lit(r) for r in RUNS]))
    rows = _prompts(spark, sf_dir).select(runs.alias("run_id"), "row_id", "prompt", "reference")
    raw = _raw(F.col("prompt"), F.col("reference"), F.col("row_id"), F.col("run_id"))
    return rows.select("run_id", "row_id", "prompt", G.clean(raw, F.col("prompt")).alias("hypothesis"), "reference")


PROMPTS_SQL = sql.few_shot_text(TEST_SQL, DEV_SQL, K, SEED, SRC, TGT)
_REF_SQL = f"SELECT row_id, reference AS text, '{TGT}' AS code FROM ({PROMPTS_SQL})"


def _outputs_sql():
    parts = []
    for run in RUNS:
        hyp = "SELECT row_id, text AS perturbed FROM ({})".format(_REF_SQL) if run == "clean" else sql.ptb_sql(
            run, _REF_SQL, ["row_id"], PTB_RATE, SEED)
        parts.append(
            f"SELECT '{run}' AS run_id, p.row_id, p.prompt || ' ' || h.perturbed || chr(10) || 'extra' AS raw "
            f"FROM ({PROMPTS_SQL}) p JOIN ({hyp}) h ON h.row_id = p.row_id WHERE length(p.prompt) <= {CONTEXT}"
        )
    return "\nUNION ALL\n".join(parts)


_ALL_RUNS_SQL = " UNION ALL ".join(f"SELECT '{r}' AS run_id" for r in RUNS)
PREDICTIONS_SQL = f"""SELECT r.run_id, p.row_id, p.prompt, {sql.clean_sql('o.raw', 'p.prompt')} AS hypothesis, p.reference
FROM ({PROMPTS_SQL}) p CROSS JOIN ({_ALL_RUNS_SQL}) r LEFT JOIN ({_outputs_sql()}) o ON p.row_id = o.row_id AND r.run_id = o.run_id"""


@register("lost_rows", f"SELECT run_id, row_id FROM ({PREDICTIONS_SQL}) WHERE hypothesis IS NULL")
def q_lost_rows(spark, sf_dir):
    """Prompts that got no output: kept in the predictions, and reported here."""
    return _predictions(spark, sf_dir).filter(F.col("hypothesis").isNull()).select("run_id", "row_id")


@register("quality_nulls", f"""SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE src IS NULL) AS n_null_src,
       count(*) FILTER (WHERE tgt IS NULL) AS n_null_tgt, count(*) FILTER (WHERE trim(src) = '') AS n_blank_src
FROM ({sql.PAIRS}) GROUP BY split""")
def q_quality_nulls(spark, sf_dir):
    """Pairs per split, and those whose texts are missing or blank."""
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    return tables.pairs(spark, sf_dir).groupBy("split").agg(
        F.count("*").alias("n_rows"), n(F.col("src").isNull(), "n_null_src"), n(F.col("tgt").isNull(), "n_null_tgt"),
        n(F.trim("src") == "", "n_blank_src"),
    )


def _count_words_model():
    """A deterministic batch model: answers with the number of characters of the prompt."""
    return lambda batch: [f"{p} {len(p)}\nextra" for p in batch]


@register("generate_batch", f"""SELECT row_id, prompt, length(prompt)::VARCHAR AS hypothesis, reference FROM ({PROMPTS_SQL})""")
def q_generate_batch(spark, sf_dir):
    """GEN-1..3: prompts through a batch model that each worker sets up once, columns carried along."""
    out = G.run(_prompts(spark, sf_dir), _count_words_model, BATCH)
    return out.select("row_id", "prompt", G.clean(F.col("raw"), F.col("prompt")).alias("hypothesis"), "reference")


@register("clean_completions", f"SELECT run_id, row_id, hypothesis FROM ({PREDICTIONS_SQL})")
def q_clean(spark, sf_dir):
    return _predictions(spark, sf_dir).select("run_id", "row_id", "hypothesis")


@register("predictions", PREDICTIONS_SQL)
def q_predictions(spark, sf_dir):
    return _predictions(spark, sf_dir)


_POS_SQL = f"SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM ({TEST_SQL})"


@register("generation_batches", f"SELECT row_id, pos, pos // {BATCH} AS batch_id FROM ({_POS_SQL})")
def q_batches(spark, sf_dir):
    test, _ = _test_dev(spark, sf_dir)
    idx = dense_index(test.select("row_id"), ["row_id"], name="pos").df
    return G.batch_ids(idx, "pos", BATCH).select("row_id", "pos", "batch_id")


@register(
    "progress_sample",
    f"""SELECT q.row_id, q.pos, p.hypothesis FROM ({_POS_SQL}) q JOIN ({PREDICTIONS_SQL}) p ON p.row_id = q.row_id
WHERE p.run_id = 'clean' AND q.pos % {BATCH} = 0 AND q.pos % 10 = 0""",
)
def q_progress(spark, sf_dir):
    test, _ = _test_dev(spark, sf_dir)
    idx = dense_index(test.select("row_id"), ["row_id"], name="pos").df
    first = idx.filter((F.col("pos") % BATCH == 0) & (F.col("pos") % 10 == 0))
    preds = _predictions(spark, sf_dir).filter(F.col("run_id") == "clean")
    return first.join(preds, "row_id").select("row_id", "pos", "hypothesis")


_BATCHED_SQL = f"""SELECT row_id, pos, prompt, concat_ws(' ', count(prompt) OVER (PARTITION BY pos // {BATCH} ORDER BY pos) - 1,
    count(prompt) OVER (PARTITION BY pos // {BATCH}), sum(length(prompt)) OVER (PARTITION BY pos // {BATCH})) AS hypothesis
  FROM ({_POS_SQL}) JOIN ({PROMPTS_SQL}) USING (row_id)"""


@register("model_batches", f"SELECT row_id, pos, pos // {BATCH} AS batch_id, CASE WHEN prompt IS NOT NULL THEN hypothesis END AS seen FROM ({_BATCHED_SQL})")
def q_model_batches(spark, sf_dir):
    """GEN-1 with GEN-4: what the model sees in each call: the prompt's place in it, its prompts and their characters."""
    out = G.run_batches(_placed_prompts(spark, sf_dir), _batch_report_model, BATCH, "pos")
    return out.select("row_id", "pos", "batch_id", G.clean(F.col("raw"), F.col("prompt")).alias("seen"))


def _placed_prompts(spark, sf_dir):
    """Prompts with their positions; only row ids are sorted."""
    test, _ = _test_dev(spark, sf_dir)
    idx = dense_index(test.select("row_id"), ["row_id"], name="pos").df
    return _prompts(spark, sf_dir).join(idx, "row_id").select("row_id", "pos", "prompt", "reference")


def _batch_report_model():
    """A deterministic batch model: answers with what it was called with."""
    return lambda batch: [f"{p} {i} {len(batch)} {sum(map(len, batch))}\nextra" for i, p in enumerate(batch)]


@register("run_report", f"""WITH p AS ({_BATCHED_SQL})
SELECT 'prompts' AS kind, NULL::BIGINT AS pos, count(*)::VARCHAR AS value FROM p
UNION ALL SELECT 'answered', NULL, count(prompt)::VARCHAR FROM p
UNION ALL SELECT 'preview', pos, prompt FROM p WHERE pos < 5
UNION ALL SELECT 'progress', pos, CASE WHEN prompt IS NOT NULL THEN hypothesis END FROM p WHERE pos % {BATCH} = 0 AND pos % 10 = 0""")
def q_run_report(spark, sf_dir):
    """SNK-5, SNK-6: a run written by one job that also counts its prompts, previews the first and marks the progress samples."""
    out = G.run_batches(_placed_prompts(spark, sf_dir), _batch_report_model, BATCH, "pos")
    hyp = G.clean(F.col("raw"), F.col("prompt"))
    pred = out.select(F.lit("clean").alias("run_id"), "row_id", "pos", "prompt", hyp.alias("hypothesis"), "reference")
    sampled = (F.col("pos") % BATCH == 0) & (F.col("pos") % 10 == 0)
    report = IO.write_reported(pred, IO.scratch_dir(spark, "report"), sampled)
    rows = [("prompts", None, str(report.n_prompts)), ("answered", None, str(report.n_answered)),
            *[("preview", i, p) for i, p in enumerate(report.preview)]]
    seen = spark.createDataFrame(rows, "kind string, pos long, value string")
    return seen.unionAll(report.progress.select(F.lit("progress"), "pos", "hypothesis"))


@register("preview", f"SELECT row_id, prompt FROM ({PROMPTS_SQL}) ORDER BY row_id LIMIT 5")
def q_preview(spark, sf_dir):
    return IO.preview(_prompts(spark, sf_dir)).select("row_id", "prompt")


@register("preview_count", f"SELECT count(*) AS n_prompts FROM ({PROMPTS_SQL})")
def q_preview_count(spark, sf_dir):
    """SNK-5: how many prompts stand behind the preview."""
    return _prompts(spark, sf_dir).agg(F.count("*").alias("n_prompts"))


@register("metrics_by_run", sql.metrics_sql(PREDICTIONS_SQL, ["run_id"], "13a"))
def q_metrics(spark, sf_dir):
    return M.score(_predictions(spark, sf_dir), ["run_id"], tokenizer="13a", basis=tables.read(spark, sf_dir, "conversations"))


@register("metrics_whitespace", sql.metrics_sql(PREDICTIONS_SQL, ["run_id"], "whitespace"))
def q_metrics_ws(spark, sf_dir):
    return M.score(_predictions(spark, sf_dir), ["run_id"], tokenizer="whitespace", basis=tables.read(spark, sf_dir, "conversations"))


@register("ngram_stats", sql.metrics_sql(PREDICTIONS_SQL, ["run_id"], "13a", long=True))
def q_ngram_stats(spark, sf_dir):
    return M.ngram_stats(_predictions(spark, sf_dir), ["run_id"], tokenizer="13a", basis=tables.read(spark, sf_dir, "conversations"))


# ---- demonstration perturbation experiments --------------------------------------------------

HOMO_ATTACK, HETERO_ATTACK = "word_order", "span_noise"


def _side(direction: str):
    """PRJ-3: the perturbed column and its language go together."""
    if direction not in ("source", "target"):
        raise ValueError(direction)
    return ("src", SRC) if direction == "source" else ("tgt", TGT)


def _homogeneous(spark, sf_dir, direction="target", attack=HOMO_ATTACK, rate=PTB_RATE):
    """PTB-9: every dev row perturbed once (keyed by dev row), then demos drawn."""
    test, dev = _test_dev(spark, sf_dir)
    col, lang = _side(direction)
    noisy_dev = dev.withColumn(col, PT.perturb(attack, F.col(col), [F.col("row_id")], lang, rate, SEED))
    out = P.few_shot(D.select_demos(test, noisy_dev, K, SEED), SRC, TGT)
    return out.select("row_id", "prompt", F.col("tgt").alias("reference"))


def _homogeneous_sql(direction="target", attack=HOMO_ATTACK, rate=PTB_RATE):
    col = "src" if direction == "source" else "tgt"
    lang = SRC if direction == "source" else TGT
    noisy = sql.ptb_sql(attack, f"SELECT row_id, {col} AS text, '{lang}' AS code FROM ({DEV_SQL})", ["row_id"], rate, SEED)
    dev = (f"SELECT d.row_id, {'n.perturbed' if col == 'src' else 'd.src'} AS src, "
           f"{'n.perturbed' if col == 'tgt' else 'd.tgt'} AS tgt FROM ({DEV_SQL}) d JOIN ({noisy}) n ON n.row_id = d.row_id")
    return sql.few_shot_text(TEST_SQL, dev, K, SEED, SRC, TGT)


for _dir in ("source", "target"):
    register(f"perturb_homogeneous_{_dir}", _homogeneous_sql(_dir))(
        (lambda d: lambda spark, sf_dir: _homogeneous(spark, sf_dir, d))(_dir)
    )

HETERO_TYPES = ("I", "II", "III", "IV")


def hetero_mask(kind: str, pos, k: int):
    """PTB-10: which demo positions are noisy. I last; II all but first; III first; IV all but last."""
    if kind == "I":
        return pos == k - 1
    if kind == "II":
        return pos >= 1
    if kind == "III":
        return pos == 0
    if kind == "IV":
        return pos < k - 1
    if kind == "all":
        return F.lit(True) if hasattr(pos, "alias") else "TRUE"
    raise ValueError(f"unknown heterogeneous type {kind!r}")


def _hetero_sql_mask(kind: str) -> str:
    return {"I": f"d.demo_pos = {K - 1}", "II": "d.demo_pos >= 1", "III": "d.demo_pos = 0",
            "IV": f"d.demo_pos < {K - 1}", "all": "TRUE"}[kind]


def _hetero(spark, sf_dir, kind, direction="target", attack=HETERO_ATTACK, rate=PTB_RATE, chat=False):
    """PTB-11/12: perturb selected demos per (test row, position) — noise redrawn per prompt."""
    test, dev = _test_dev(spark, sf_dir)
    col, lang = _side(direction)
    with_demos = D.select_demos(test, dev, K, SEED)
    demos = F.col("demos")
    keys = F.transform(demos, lambda d: F.when(hetero_mask(kind, d["pos"], K), F.concat_ws("|", F.col("row_id"), d["pos"])))
    texts = PT.perturb_each(attack, F.transform(demos, lambda d: d[col]), keys, lang, rate, SEED)
    noisy = F.zip_with(demos, texts, lambda d, x: d.withField(col, x))
    out = P.few_shot(with_demos.withColumn("demos", noisy), SRC, TGT, chat=chat)
    if chat:
        return P.messages_long(out, ["row_id"])
    return out.select("row_id", "prompt", F.col("tgt").alias("reference"))


def _hetero_sql(kind, direction="target", attack=HETERO_ATTACK, rate=PTB_RATE, chat=False):
    col = "src" if direction == "source" else "tgt"
    lang = SRC if direction == "source" else TGT
    demos = sql.demos_cte(TEST_SQL, DEV_SQL, K, SEED) + "\nSELECT row_id, demo_pos, d_src, d_tgt FROM demos"
    src_rows = f"SELECT row_id, demo_pos, d_{col} AS text, '{lang}' AS code FROM ({demos})"
    noisy = sql.ptb_sql(attack, src_rows, ["row_id", "demo_pos"], rate, SEED)
    mask = _hetero_sql_mask(kind)
    pick = f"CASE WHEN {mask} THEN n.perturbed ELSE d.d_{col} END"
    nd = (f"SELECT d.row_id, d.demo_pos, {pick if col == 'src' else 'd.d_src'} AS d_src, "
          f"{pick if col == 'tgt' else 'd.d_tgt'} AS d_tgt FROM ({demos}) d "
          f"JOIN ({noisy}) n ON n.row_id = d.row_id AND n.demo_pos = d.demo_pos")
    s, t = "English", "German"
    nl = chr(10)
    if chat:
        return f"""WITH test AS ({TEST_SQL}), demos AS ({nd}),
msgs AS (
  SELECT row_id, 0 AS msg_idx, 'system' AS role, {sql.lit(f'Translate this from {s} into {t}.{nl}{nl}')} AS content FROM test
  UNION ALL SELECT row_id, 1 + 2 * demo_pos, 'user', {sql.lit(s + ': ')} || d_src || {sql.lit(nl + t + ': ')} FROM demos
  UNION ALL SELECT row_id, 2 + 2 * demo_pos, 'assistant', d_tgt || {sql.lit(nl + nl)} FROM demos
  UNION ALL SELECT row_id, {1 + 2 * K}, 'user', {sql.lit(s + ': ')} || src || {sql.lit(nl + t + ': ')} FROM test)
SELECT row_id, msg_idx::INTEGER AS msg_idx, role, content FROM msgs"""
    block = (f"string_agg({sql.lit(s + ': ')} || d_src || {sql.lit(nl + t + ': ')} || d_tgt || {sql.lit(nl + nl)}, '' "
             f"ORDER BY demo_pos)")
    return f"""WITH test AS ({TEST_SQL}), demos AS ({nd}),
blocks AS (SELECT row_id, {block} AS block FROM demos GROUP BY row_id)
SELECT t.row_id, {sql.lit(f'Translate this from {s} into {t}:{nl}{nl}')} || coalesce(b.block, '') || {sql.lit(s + ': ')} || t.src
       || {sql.lit(nl + t + ': ')} AS prompt, t.tgt AS reference
FROM test t LEFT JOIN blocks b ON b.row_id = t.row_id"""


for _kind in HETERO_TYPES:
    register(f"perturb_hetero_{_kind}", _hetero_sql(_kind))(
        (lambda kd: lambda spark, sf_dir: _hetero(spark, sf_dir, kd))(_kind)
    )
register("perturb_selected_all", _hetero_sql("all", direction="source", attack="word_duplication"))(
    lambda spark, sf_dir: _hetero(spark, sf_dir, "all", direction="source", attack="word_duplication")
)
register("perturb_hetero_chat", _hetero_sql("II", chat=True))(
    lambda spark, sf_dir: _hetero(spark, sf_dir, "II", chat=True)
)


# ---- allied task and directionality ------------------------------------------------------------

def _allied(spark, sf_dir, chat=False):
    """JOIN-3: test (src, tgt) with an allied pool (aux, tgt) sharing only the target language."""
    test, _ = _test_dev(spark, sf_dir)
    aux_dev = _split(tables.aux_pairs(spark, sf_dir), "dev")
    out = P.allied(D.select_demos(test, aux_dev, K, SEED), SRC, AUX, TGT, chat=chat)
    if chat:
        return P.messages_long(out, ["row_id"])
    return out.select("row_id", "prompt", F.col("tgt").alias("reference"))


register("allied_prompt", sql.few_shot_text(TEST_SQL, AUX_DEV_SQL, K, SEED, SRC, TGT, demo_label="French",
                                            instr=sql.lit("Translate this into German:\n\n")))(
    lambda spark, sf_dir: _allied(spark, sf_dir)
)
register("allied_chat", sql.few_shot_chat(TEST_SQL, AUX_DEV_SQL, K, SEED, SRC, TGT, demo_label="French",
                                          system=sql.lit("Translate this into German:\n\n")))(
    lambda spark, sf_dir: _allied(spark, sf_dir, chat=True)
)


def _directionality(spark, sf_dir):
    """JOIN-4: one plan, two arms — source-original and target-original demonstration pools."""
    test, dev = _test_dev(spark, sf_dir)
    arms = {"target": dev, "source": _split(tables.aux_pairs(spark, sf_dir), "dev")}
    out = None
    for origin, pool in arms.items():
        p = P.few_shot(D.select_demos(test, pool, K, SEED), SRC, TGT).select(
            F.lit(origin).alias("origin"), "row_id", "prompt"
        )
        out = p if out is None else out.unionByName(p)
    return out


register(
    "directionality_prompt",
    f"SELECT 'target' AS origin, row_id, prompt FROM ({sql.few_shot_text(TEST_SQL, DEV_SQL, K, SEED, SRC, TGT)})\n"
    f"UNION ALL SELECT 'source' AS origin, row_id, prompt FROM ({sql.few_shot_text(TEST_SQL, AUX_DEV_SQL, K, SEED, SRC, TGT)})",
)(_directionality)


# ---- experiment grids ---------------------------------------------------------------------------

from icx.plans import grid as GR  # noqa: E402
from icx.functions.scripts import LANGUAGES, script_of  # noqa: E402


def _doc_codes(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select(tables.lang_code_col(F.col("lang")).alias("code"))


def _pairs(spark, sf_dir):
    return GR.language_pairs(_doc_codes(spark, sf_dir))


_CODES_SQL = f"SELECT DISTINCT {sql.LANG_CODE} AS code FROM documents"
_PAIRS_SQL = f"SELECT a.code AS src_lang, b.code AS tgt_lang FROM ({_CODES_SQL}) a JOIN ({_CODES_SQL}) b ON a.code <> b.code"


# The parameter lists of the six experiments, written out as relations.
_SHOTS_SQL = "(VALUES (1), (4), (8)) s(shots)"
_ATTACKS_SQL = ("(VALUES ('span_noise'), ('word_duplication'), ('punctuation_drop_attack'), ('punctuation_add_attack'), "
                "('ocr'), ('word_order')) a(attack)")
_RATES_SQL = "(VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) r(rate)"
_DIRECTIONS_SQL = "(VALUES ('source'), ('target')) d(direction)"
_NO = {"kind": "NULL::VARCHAR", "attack": "NULL::VARCHAR", "rate": "NULL::DOUBLE", "direction": "NULL::VARCHAR",
       "htype": "NULL::VARCHAR", "variant": "NULL::VARCHAR"}


def _grid_row(experiment, source, shots="shots", seed="42", **given):
    cols = _NO | given
    return (f"SELECT '{experiment}' AS experiment, {shots}::INTEGER AS shots, {cols['kind']} AS kind, {seed}::INTEGER AS seed, "
            f"{cols['attack']} AS attack, {cols['rate']} AS rate, {cols['direction']} AS direction, {cols['htype']} AS htype, "
            f"{cols['variant']} AS variant FROM {source}")


_NOISY = {"attack": "attack", "rate": "rate", "direction": "direction"}
_GRIDS_SQL = {
    "instruction": _grid_row("instruction", _SHOTS_SQL + ", (VALUES ('standard'), ('generic'), ('random'), ('contrastive'), ('no_instruct')) k(kind)",
                             kind="kind"),
    "directionality": _grid_row("directionality", _SHOTS_SQL + ", (VALUES (0), (25), (42)) e(sd)", seed="sd"),
    "homogeneous": _grid_row("homogeneous", _SHOTS_SQL) + " UNION ALL " + _grid_row(
        "homogeneous", f"{_SHOTS_SQL}, {_ATTACKS_SQL}, {_RATES_SQL}, {_DIRECTIONS_SQL}", **_NOISY),
    "heterogeneous": _grid_row(
        "heterogeneous", f"{_SHOTS_SQL}, {_ATTACKS_SQL}, {_RATES_SQL}, {_DIRECTIONS_SQL}, (VALUES ('I'), ('II'), ('III'), ('IV')) h(htype) "
        "WHERE shots > 1 AND attack NOT LIKE 'punctuation%'", **_NOISY, htype="htype"),
    "allied": _grid_row("allied", _SHOTS_SQL),
    "pivot": _grid_row("pivot", "(VALUES ('I'), ('II'), ('III'), ('IV')) v(variant)", shots="0", variant="variant"),
}


def _grid_sql(experiments):
    return " UNION ALL ".join(_GRIDS_SQL[e] for e in experiments)


_RUN_ID_SQL = ("md5(concat_ws('|', experiment, src_lang, tgt_lang, coalesce(aux_lang, ''), coalesce(pivot_lang, ''), shots::VARCHAR, "
               "coalesce(kind, ''), seed::VARCHAR, coalesce(attack, ''), coalesce(rate::VARCHAR, ''), coalesce(direction, ''), "
               "coalesce(htype, ''), coalesce(variant, '')))")


def _runs_sql(pairs_sql, experiments, model=GR.DEFAULT_MODEL):
    m = sql.lit(model.split("/")[-1])
    pm = "CASE " + " ".join(f"WHEN attack = '{a}' THEN '{p}'" for a, p in PT.RATE_PARAM.items()) + " END"
    shot = "(shots::VARCHAR || 'shot')"
    base = f"concat_ws('-', {m}, src_lang, tgt_lang, {shot})"
    ap = f"CASE WHEN attack IS NULL THEN 'clean' ELSE attack || '-' || {pm} || '_' || rate::VARCHAR END"
    name = (f"CASE experiment WHEN 'instruction' THEN concat_ws('-', {base}, kind) WHEN 'directionality' THEN {base} "
            f"WHEN 'homogeneous' THEN concat_ws('-', {base}, {ap}) "
            f"WHEN 'heterogeneous' THEN concat_ws('-', {base}, {ap}, 'heterogeneous', htype) "
            f"WHEN 'allied' THEN concat_ws('-', {m}, src_lang, aux_lang, tgt_lang, {shot}) "
            f"ELSE concat_ws('-', {m}, src_lang, pivot_lang, tgt_lang, 'variant', variant) END")
    bs = lambda t: "CASE shots " + " ".join(f"WHEN {k} THEN {b}" for k, b in t.items()) + " ELSE error('no batch size') END"
    batch = (f"CASE WHEN experiment = 'pivot' THEN {GR.PIVOT_BATCH_SIZE} WHEN experiment = 'heterogeneous' "
             f"THEN {bs(GR.HETERO_BATCH_SIZES)} ELSE {bs(GR.BATCH_SIZES)} END")
    chat = "TRUE" if model in GR.CHAT_MODELS else "FALSE"
    return f"""SELECT experiment, src_lang, tgt_lang, aux_lang, pivot_lang, shots, kind, seed, attack, rate, direction, htype,
       variant, {pm} AS param, {name} AS run_name, {_RUN_ID_SQL} AS run_id, ({batch})::INTEGER AS batch_size, {chat} AS chat_format
FROM (SELECT p.*, g.* FROM ({pairs_sql}) p CROSS JOIN ({_grid_sql(experiments)}) g)"""


def _with_null(pairs_sql, *cols):
    return f"SELECT *, {', '.join(f'NULL::VARCHAR AS {c}' for c in cols)} FROM ({pairs_sql})"


for _e in ("instruction", "directionality", "homogeneous", "heterogeneous"):
    register(f"grid_{_e}", _runs_sql(_with_null(_PAIRS_SQL, "aux_lang", "pivot_lang"), (_e,)))(
        (lambda e: lambda spark, sf_dir: GR.runs(_pairs(spark, sf_dir), (e,)))(_e)
    )


def _pick_sql(codes, h, src="src_lang", tgt="tgt_lang"):
    arr = "[" + ", ".join(sql.lit(c) for c in codes) + "]"
    L = len(codes)
    ps, pt = f"(coalesce(list_position({arr}, {src}), 0) - 1)", f"(coalesce(list_position({arr}, {tgt}), 0) - 1)"
    lo = f"(CASE WHEN {ps} >= 0 AND {pt} >= 0 THEN least({ps}, {pt}) WHEN {ps} >= 0 THEN {ps} WHEN {pt} >= 0 THEN {pt} END)"
    hi = f"(CASE WHEN {ps} >= 0 AND {pt} >= 0 AND {ps} <> {pt} THEN greatest({ps}, {pt}) END)"
    avail = f"({L} - (CASE WHEN {lo} IS NOT NULL THEN 1 ELSE 0 END) - (CASE WHEN {hi} IS NOT NULL THEN 1 ELSE 0 END))"
    r = f"(CASE WHEN {avail} > 0 THEN {h} % {avail} END)"
    i1 = f"(CASE WHEN {lo} IS NOT NULL AND {r} >= {lo} THEN {r} + 1 ELSE {r} END)"
    i2 = f"(CASE WHEN {hi} IS NOT NULL AND {i1} >= {hi} THEN {i1} + 1 ELSE {i1} END)"
    return f"(CASE WHEN {avail} > 0 THEN {arr}[{i2} + 1] END)"


def _allied_sql(pairs_sql, seed=SEED):
    codes = sorted(LANGUAGES)
    by_script = {}
    for c in codes:
        by_script.setdefault(script_of(c), []).append(c)
    hs = sql.u60(seed, "allied_script", "src_lang", "tgt_lang")
    same = "CASE split_part(src_lang, '_', 2) " + " ".join(
        f"WHEN '{sc}' THEN {_pick_sql(lst, hs)}" for sc, lst in by_script.items()) + " END"
    rnd = _pick_sql(codes, sql.u60(seed, "allied_random", "src_lang", "tgt_lang"))
    return f"""SELECT src_lang, tgt_lang, 'same' AS choice, src_lang AS aux_lang FROM ({pairs_sql})
UNION ALL SELECT src_lang, tgt_lang, 'english', 'eng_Latn' FROM ({pairs_sql})
UNION ALL SELECT src_lang, tgt_lang, 'same_script', {same} FROM ({pairs_sql})
UNION ALL SELECT src_lang, tgt_lang, 'random', {rnd} FROM ({pairs_sql})"""


@register("allied_languages", _allied_sql(_PAIRS_SQL))
def q_allied_languages(spark, sf_dir):
    return GR.allied_choices(_pairs(spark, sf_dir), SEED)


@register("grid_allied", _runs_sql(f"SELECT src_lang, tgt_lang, aux_lang, NULL::VARCHAR AS pivot_lang FROM ({_allied_sql(_PAIRS_SQL)})", ("allied",)))
def q_grid_allied(spark, sf_dir):
    aux = GR.allied_choices(_pairs(spark, sf_dir), SEED).select("src_lang", "tgt_lang", "aux_lang")
    return GR.runs(aux, ("allied",))


@register("grid_pivot", _runs_sql(
    f"SELECT src_lang, tgt_lang, NULL::VARCHAR AS aux_lang, 'eng_Latn' AS pivot_lang FROM ({_PAIRS_SQL}) "
    f"WHERE src_lang <> 'eng_Latn' AND tgt_lang <> 'eng_Latn'", ("pivot",)))
def q_grid_pivot(spark, sf_dir):
    p = _pairs(spark, sf_dir).filter((F.col("src_lang") != "eng_Latn") & (F.col("tgt_lang") != "eng_Latn"))
    return GR.runs(p.withColumn("pivot_lang", F.lit("eng_Latn")), ("pivot",))


_ALL_GRID_SQL = " UNION ALL ".join([
    _runs_sql(_with_null(_PAIRS_SQL, "aux_lang", "pivot_lang"), ("instruction", "directionality", "homogeneous", "heterogeneous")),
    _runs_sql(f"SELECT DISTINCT src_lang, tgt_lang, aux_lang, NULL::VARCHAR AS pivot_lang FROM ({_allied_sql(_PAIRS_SQL)}) WHERE aux_lang IS NOT NULL",
              ("allied",)),
    _runs_sql(f"SELECT src_lang, tgt_lang, NULL::VARCHAR AS aux_lang, 'eng_Latn' AS pivot_lang FROM ({_PAIRS_SQL}) "
              f"WHERE src_lang <> 'eng_Latn' AND tgt_lang <> 'eng_Latn'", ("pivot",)),
])


@register("grid_all", _ALL_GRID_SQL)
def q_grid_all(spark, sf_dir):
    return GR.all_runs(_pairs(spark, sf_dir), SEED)


# ---- the whole grid of the data's language pair, run in one job ---------------------------------

from icx.plans import study as ST_  # noqa: E402


def grid_predictions(spark, sf_dir):
    test, dev = _test_dev(spark, sf_dir)
    aux_dev = _split(tables.aux_pairs(spark, sf_dir), "dev")
    asked = ST_.prompts(test, dev, aux_dev, tables.triples(spark, sf_dir), SRC, TGT, AUX, PIVOT)
    return ST_.predictions(asked, CONTEXT)


# Checked run by run against the single-run queries (tests/test_study.py): as one SQL
# statement, 431 runs of perturbed demonstrations take DuckDB longer than the gate allows.
register("grid_predictions", None)(grid_predictions)
register("grid_metrics", None)(lambda spark, sf_dir: ST_.scores(grid_predictions(spark, sf_dir)))


# ---- sources and sinks ----------------------------------------------------------------------------

from icx.sources import fanout as FO  # noqa: E402

_SENT_SQL = f"SELECT row_number() OVER (PARTITION BY {sql.LANG_CODE} ORDER BY doc_id) - 1 AS row_id, {sql.LANG_CODE} AS code, text FROM documents"


@register("sentences", _SENT_SQL)
def q_sentences(spark, sf_dir):
    return tables.sentences(spark, sf_dir)


_FAN_SQL = f"""SELECT p.src_lang, p.tgt_lang, s.row_id, s.text AS src, t.text AS tgt
FROM ({_PAIRS_SQL}) p JOIN ({_SENT_SQL}) s ON s.code = p.src_lang JOIN ({_SENT_SQL}) t ON t.code = p.tgt_lang AND t.row_id = s.row_id"""


@register("pair_fan_out", _FAN_SQL)
def q_fan_out(spark, sf_dir):
    return FO.fan_out(tables.sentences(spark, sf_dir), _pairs(spark, sf_dir))


def _cat_sql():
    vals = ("('facebook/flores', 'flores', 'dev', 'dev'), ('facebook/flores', 'flores', 'test', 'devtest'), "
            "('ai4bharat/IN22-Gen', 'in22', 'test', 'gen')")
    return f"""SELECT c.dataset, c.short, c.split, c.source_split, p.src_lang, p.tgt_lang,
       'data/' || c.split || '/' || c.short || '_' || p.src_lang || '-' || p.tgt_lang || '.jsonl' AS path
FROM ({_PAIRS_SQL}) p CROSS JOIN (VALUES {vals}) c(dataset, short, split, source_split)"""


@register("pair_catalogue", _cat_sql())
def q_catalogue(spark, sf_dir):
    return FO.catalogue(_pairs(spark, sf_dir))


#: Pairs that a download of sentences in these languages would ask for, besides those of the data.
WANTED = ("eng_Latn", "hin_Deva", "ita_Latn")


@register("missing_pairs", f"""SELECT w.src_lang, w.tgt_lang FROM (SELECT a.code AS src_lang, b.code AS tgt_lang
  FROM (SELECT code FROM ({_CODES_SQL}) UNION SELECT unnest(['eng_Latn', 'hin_Deva', 'ita_Latn'])) a
  JOIN (SELECT code FROM ({_CODES_SQL}) UNION SELECT unnest(['eng_Latn', 'hin_Deva', 'ita_Latn'])) b ON a.code <> b.code) w
WHERE NOT EXISTS (SELECT 1 FROM ({_SENT_SQL}) s JOIN ({_SENT_SQL}) t ON s.row_id = t.row_id
                  WHERE s.code = w.src_lang AND t.code = w.tgt_lang)""")
def q_missing_pairs(spark, sf_dir):
    """SRC-1's report: wanted language pairs without any sentence pair."""
    codes = _doc_codes(spark, sf_dir).distinct().unionByName(spark.createDataFrame([(c,) for c in WANTED], "code string")).distinct()
    sent = tables.sentences(spark, sf_dir)
    return FO.missing_pairs(FO.fan_out(sent, GR.language_pairs(codes)), GR.language_pairs(codes))


@register("fan_out_resumed", f"""WITH codes AS (SELECT code FROM ({_CODES_SQL}) UNION SELECT unnest(['eng_Latn', 'hin_Deva', 'ita_Latn'])),
n AS (SELECT src_lang, tgt_lang, count(*) AS n_rows, sum(length(src) + length(tgt))::BIGINT AS chars FROM ({_FAN_SQL}) GROUP BY ALL)
SELECT a.code AS src_lang, b.code AS tgt_lang, coalesce(n.n_rows, 0) AS n_rows, coalesce(n.chars, 0) AS chars,
  CASE WHEN n.n_rows IS NULL THEN 'missing' WHEN a.code = '{SRC}' AND b.code = '{TGT}' THEN 'failed' ELSE 'done' END AS first_status,
  CASE WHEN n.n_rows IS NULL THEN 'missing' ELSE 'done' END AS last_status,
  n.n_rows IS NOT NULL AND a.code = '{SRC}' AND b.code = '{TGT}' AS written_last
FROM codes a JOIN codes b ON a.code <> b.code LEFT JOIN n ON n.src_lang = a.code AND n.tgt_lang = b.code""")
def q_fan_out_resumed(spark, sf_dir):
    """SRC-1, SNK-2: the fan-out written while one pair fails, started again without the fault, and read back."""
    codes = _doc_codes(spark, sf_dir).distinct().unionByName(spark.createDataFrame([(c,) for c in WANTED], "code string")).distinct()
    wanted = GR.language_pairs(codes)
    rows = FO.fan_out(tables.sentences(spark, sf_dir), wanted)
    fails = (F.col("src_lang") == SRC) & (F.col("tgt_lang") == TGT)
    faulty = rows.withColumn("src", F.when(fails, F.raise_error(F.lit("this pair cannot be read")).cast("string")).otherwise(F.col("src")))
    path = IO.scratch_dir(spark, "fan-out")
    first = FO.write_fan_out(faulty, wanted, path)
    first = spark.createDataFrame(first.collect(), first.schema)  # one row per language pair, as it was before the second run
    last = FO.write_fan_out(rows, wanted, path)
    sizes = FO.read_fan_out(spark, path).groupBy(*FO.PAIR).agg(F.sum(F.length("src") + F.length("tgt")).alias("chars"))
    out = first.select(*FO.PAIR, F.col("status").alias("first_status")).join(last, FO.PAIR).join(sizes, FO.PAIR, "left")
    return out.select(*FO.PAIR, "n_rows", F.coalesce("chars", F.lit(0)).alias("chars"), "first_status", F.col("status").alias("last_status"),
                      F.expr("written AND status = 'done'").alias("written_last"))


def _lang_values():
    rows = ", ".join(f"({sql.lit(c)}, {sql.lit(n)})" for c, n in sorted(LANGUAGES.items()))
    return f"(VALUES {rows}) l(code, name)"


# ---- the study over every language pair of the data, one job -------------------------------------

def _pair_study_sql(experiments):
    steps = []
    for m in range(max(GR.SHOTS)):
        steps.append(f"""s{m + 1} AS (SELECT src_lang, tgt_lang, row_id, shots, seed, d, CASE WHEN shots <= {m} THEN s WHEN list_contains(s, t) THEN list_append(s, j) ELSE list_append(s, t) END AS s
  FROM (SELECT *, ('0x' || substr(md5(concat_ws('|', seed, 'demo', row_id, j)), 1, 15))::BIGINT % greatest(j + 1, 1) AS t FROM (SELECT *, (d - shots + {m})::BIGINT AS j FROM s{m})))""")
    head = "CASE kind " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in (
        ("generic", sql.instruction_sql("generic", "", "", False, SEED)), ("random", sql.instruction_sql("random", "", "", False, SEED, "p.row_id")),
        ("contrastive", "'Translate this from ' || t.name || ' into ' || s.name || ' :' || chr(10) || chr(10)"), ("no_instruct", "''"),
    )) + " ELSE 'Translate this from ' || s.name || ' into ' || t.name || ':' || chr(10) || chr(10) END"
    names = lambda side: f"(SELECT c.code, coalesce(l.name, c.code) AS name FROM ({_CODES_SQL}) c LEFT JOIN {_lang_values()} ON l.code = c.code) {side}"
    return f"""WITH f AS ({_FAN_SQL}),
test AS (SELECT * FROM f WHERE row_id % 4 = 0),
dev AS (SELECT *, row_number() OVER (PARTITION BY src_lang, tgt_lang ORDER BY row_id) - 1 AS idx FROM f WHERE row_id % 4 <> 0),
n AS (SELECT src_lang, tgt_lang, count(*) AS d FROM dev GROUP BY ALL),
g AS (SELECT * FROM ({_runs_sql(_with_null(_PAIRS_SQL, "aux_lang", "pivot_lang"), experiments)}) WHERE attack IS NULL),
s0 AS (SELECT src_lang, tgt_lang, row_id, shots, seed, d, []::BIGINT[] AS s FROM test JOIN n USING (src_lang, tgt_lang)
  JOIN (SELECT DISTINCT src_lang, tgt_lang, shots, seed FROM g) USING (src_lang, tgt_lang) WHERE d >= shots),
{", ".join(steps)},
picked AS (SELECT * EXCLUDE (s), unnest(s) AS v FROM s{max(GR.SHOTS)}),
placed AS (SELECT *, row_number() OVER (PARTITION BY src_lang, tgt_lang, row_id, shots, seed
  ORDER BY ('0x' || substr(md5(concat_ws('|', seed, 'demo_order', row_id, v)), 1, 15))::BIGINT, v) AS pos FROM picked),
blocks AS (SELECT o.src_lang, o.tgt_lang, o.row_id, o.shots, o.seed,
  CASE WHEN bool_and(dev.src IS NOT NULL AND dev.tgt IS NOT NULL) THEN
    string_agg(s.name || ': ' || dev.src || chr(10) || t.name || ': ' || dev.tgt || chr(10) || chr(10), '' ORDER BY pos) END AS block
  FROM placed o JOIN dev ON dev.src_lang = o.src_lang AND dev.tgt_lang = o.tgt_lang AND dev.idx = o.v
    JOIN {names("s")} ON s.code = o.src_lang JOIN {names("t")} ON t.code = o.tgt_lang GROUP BY ALL)
SELECT g.run_id, p.src_lang, p.tgt_lang, g.experiment, p.row_id, p.shots,
  {head} || p.block || s.name || ': ' || test.src || chr(10) || t.name || ': ' AS prompt, test.tgt AS reference
FROM blocks p JOIN g USING (src_lang, tgt_lang, shots, seed) JOIN test USING (src_lang, tgt_lang, row_id)
  JOIN {names("s")} ON s.code = p.src_lang JOIN {names("t")} ON t.code = p.tgt_lang"""


_PAIR_STUDY = ("instruction", "directionality", "homogeneous")


def _pair_study(spark, sf_dir, outcome):
    """Over the sentence pairs of all language pairs; every fourth sentence is a test row."""
    return ST_.outcome_of_sentences(tables.sentences(spark, sf_dir), _pairs(spark, sf_dir), F.col("row_id") % 4 == 0, outcome, _PAIR_STUDY)


def _pair_digest_sql(study):
    return f"""SELECT run_id, src_lang, tgt_lang, experiment, row_id, shots, length(prompt)::BIGINT AS n_chars, md5(prompt) AS prompt_md5,
  length(reference)::BIGINT AS reference_chars FROM ({study})"""


@register("study_all_pairs", _pair_digest_sql(_pair_study_sql(_PAIR_STUDY)))
def q_study_all_pairs(spark, sf_dir):
    """Every unperturbed run of `grid_all` with its own pool, over all language pairs: its prompts by digest."""
    def digest(prompts):
        own = prompts.select(*ST_.PAIR, "row_id", "shots", "n_chars", F.md5("prompt").alias("prompt_md5"),
                             F.char_length("reference").cast("long").alias("reference_chars"), "runs")
        return own.withColumn("run", F.explode("runs")).select("run.run_id", *ST_.PAIR, "run.experiment", "row_id", "shots", "n_chars", "prompt_md5", "reference_chars")

    return _pair_study(spark, sf_dir, digest)


@register("study_run_sizes", f"""SELECT run_id, src_lang, tgt_lang, experiment, shots, count(*) AS n_rows, count(prompt) AS n_prompts,
  sum(length(prompt))::BIGINT AS n_chars, count(*) FILTER (length(prompt) <= {{context}}) AS n_fitting FROM ({_pair_study_sql(_PAIR_STUDY)}) GROUP BY ALL""".replace("{context}", str(CONTEXT)))
def q_study_run_sizes(spark, sf_dir):
    """One row per run over all language pairs: its prompts, their size, and how many fit the model's context."""
    run = ["run_id", *ST_.PAIR, "experiment", "shots"]

    def sizes(prompts):
        own = prompts.select(*ST_.PAIR, "shots", F.when(F.col("prompt").isNotNull(), F.col("n_chars")).alias("n"), "runs")
        return own.withColumn("run", F.explode("runs")).select("run.run_id", *ST_.PAIR, "run.experiment", "shots", "n").groupBy(*run).agg(
            F.count("*").alias("n_rows"), F.count("n").alias("n_prompts"), F.sum("n").alias("n_chars"), F.count_if(F.col("n") <= CONTEXT).alias("n_fitting"))

    waves = _pair_study(spark, sf_dir, sizes)
    return waves.groupBy(*run).agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_prompts", "n_chars", "n_fitting")])


@register("unknown_languages", f"SELECT code, count(*) AS n FROM (SELECT {sql.LANG_CODE} AS code FROM documents) WHERE code LIKE '%\\_Zyyy' ESCAPE '\\' GROUP BY code")
def q_unknown_languages(spark, sf_dir):
    """Languages of the documents that the code table does not know, with their documents."""
    codes = _doc_codes(spark, sf_dir)
    return codes.filter(F.col("code").endswith("_Zyyy")).groupBy("code").agg(F.count("*").alias("n"))


@register("jsonl_roundtrip", f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, src, tgt FROM ({DEV_SQL})")
def q_jsonl_roundtrip(spark, sf_dir):
    """SNK-2 then SRC-2/3: dev pairs written as sentence_* JSON Lines and read back in file order."""
    _, dev = _test_dev(spark, sf_dir)
    out = IO.scratch_dir(spark, "pairs") + "/dev.jsonl"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (dev.repartitionByRange(n, "row_id").sortWithinPartitions("row_id")
        .select(F.col("src").alias(f"sentence_{SRC}"), F.col("tgt").alias(f"sentence_{TGT}"))
        .write.mode("overwrite").json(out))
    return IO.read_pairs(spark, out, SRC, TGT)


_LINES_SQL = f"""SELECT doc_id AS row_id, unnest(range(len(string_split(text, chr(10))))) AS line_no,
       unnest(string_split(text, chr(10))) AS text, 'eng_Latn' AS code FROM documents"""


@register("perturb_text_lines", f"""SELECT row_id, line_no::INTEGER AS line_no,
       replace({sql.strip('perturbed')}, chr(10), '') AS text FROM ({sql.ptb_sql(
    "word_order", f"SELECT row_id, line_no, {sql.strip('text')} AS text, code FROM ({_LINES_SQL})", ["row_id", "line_no"],
    PT.DEFAULT_RATES["word_order"], SEED)})""")
def q_perturb_text_lines(spark, sf_dir):
    """PTB-8 over every line of every document: strip, perturb, strip, drop newlines."""
    d = tables.spread(tables.read(spark, sf_dir, "documents"), "doc_id")
    lines = d.select(F.col("doc_id").alias("row_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    out = IO.perturb_lines(lines, "eng_Latn", "word_order", PT.DEFAULT_RATES["word_order"], SEED, keys=("row_id", "line_no"))
    return out.select("row_id", "line_no", "text")


# ---- file jobs: written, read back, in order ------------------------------------------------------

_FILE_LINES_SQL = (f"SELECT row_number() OVER (ORDER BY row_id, line_no) - 1 AS line_no, {sql.strip('text')} AS text, 'eng_Latn' AS code "
                   f"FROM ({_LINES_SQL})")


@register("perturb_file_job", f"""SELECT line_no, replace({sql.strip('perturbed')}, chr(10), '') AS text
FROM ({sql.ptb_sql("word_order", _FILE_LINES_SQL, ["line_no"], PT.DEFAULT_RATES["word_order"], SEED)})""")
def q_perturb_file_job(spark, sf_dir):
    """PTB-8, SRC-6, SNK-1: all lines of the documents as a text file, perturbed line by line into another, read in order."""
    d = tables.spread(tables.read(spark, sf_dir, "documents"), "doc_id")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    source, target = IO.scratch_dir(spark, "lines-in"), IO.scratch_dir(spark, "lines-out")
    POS.write_ordered(lines, source, "doc_id", "at")
    IO.perturb_text(spark, f"{source}/{POS.LINES}", target, "eng_Latn", "word_order", seed=SEED)
    return IO.read_perturbed(spark, target)


def _file_rows_sql(pairs):
    return f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS n, src, tgt FROM ({pairs})"


@register("pivot_from_files", f"""SELECT a.n AS sp_id, b.n AS pt_id, a.src, a.tgt AS "pivot", b.tgt
FROM ({_file_rows_sql(sql.PAIRS)}) a JOIN ({_file_rows_sql(sql.AUX_PAIRS)}) b ON a.tgt = b.src""")
def q_pivot_from_files(spark, sf_dir):
    """SRC-5: the pivot study's triples from two pair files, each found and read by the English-first rule."""
    base = IO.scratch_dir(spark, "pivot-files")
    sides = []
    for pairs, src_lang, tgt_lang in ((tables.pairs(spark, sf_dir), SRC, TGT), (tables.aux_pairs(spark, sf_dir), TGT, PIVOT)):
        path, src_col, tgt_col = FO.pair_file("flores", "dev", src_lang, tgt_lang)
        (pairs.repartitionByRange("row_id").sortWithinPartitions("row_id")
            .select(F.col("src").alias(src_col), F.col("tgt").alias(tgt_col)).write.json(f"{base}/{path}"))
        sides.append(IO.read_pairs(spark, f"{base}/{path}", src_lang, tgt_lang))
    first, second = sides
    left = first.select(F.col("row_id").alias("sp_id"), "src", F.col("tgt").alias("pivot"))
    right = second.select(F.col("row_id").alias("pt_id"), F.col("src").alias("pivot2"), "tgt")
    return left.join(right, left.pivot == right.pivot2).select("sp_id", "pt_id", "src", "pivot", "tgt")


@register("predictions_sink", PREDICTIONS_SQL)
def q_predictions_sink(spark, sf_dir):
    """SNK-3: the predictions table, partitioned by run, its runs written twice, read back."""
    path = IO.scratch_dir(spark, "predictions")
    rows = _predictions(spark, sf_dir).select("run_id", "row_id", "prompt", "hypothesis", "reference")
    for _ in range(2):  # a job that is started again
        IO.write_predictions(rows, path)
    return IO.read_runs(spark, path, rows.schema)


@register("metrics_sink", sql.metrics_sql(PREDICTIONS_SQL, ["run_id"], "13a"))
def q_metrics_sink(spark, sf_dir):
    """SNK-4: one row per run in the metrics table, read back."""
    path = IO.scratch_dir(spark, "metrics")
    rows = M.score(_predictions(spark, sf_dir), ["run_id"])
    IO.write_metrics(rows, path)
    return IO.read_runs(spark, path, rows.schema)


def _damaged(pairs):
    """Pairs as JSON lines; every seventh line is cut short, every eleventh is no object."""
    line = F.to_json(F.struct(F.coalesce("src", F.lit("")).alias(f"sentence_{SRC}"), F.coalesce("tgt", F.lit("")).alias(f"sentence_{TGT}")))
    cut = F.concat(F.lit('{"sentence_'), F.col("row_id").cast("string"))
    return pairs.select("row_id", F.when(F.col("row_id") % 7 == 3, cut).when(F.col("row_id") % 11 == 5, F.concat(F.lit("no object "), F.col("row_id").cast("string")))
                        .otherwise(line).alias("value"))


def _damaged_file(spark, sf_dir):
    path = IO.scratch_dir(spark, "damaged") + "/dev.jsonl"
    rows = _damaged(tables.pairs(spark, sf_dir))
    rows.repartitionByRange("row_id").sortWithinPartitions("row_id").select("value").write.text(path)
    return path


_NUMBERED_SQL = f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS n, row_id, src, tgt FROM ({sql.PAIRS})"


@register("bad_lines", f"""SELECT n AS row_id, CASE WHEN row_id % 7 = 3 THEN '{{"sentence_' || row_id ELSE 'no object ' || row_id END AS line
FROM ({_NUMBERED_SQL}) WHERE row_id % 7 = 3 OR row_id % 11 = 5""")
def q_bad_lines(spark, sf_dir):
    """SRC-2/VAL-1: the malformed lines of a pair file made of all pairs, by position."""
    return IO.bad_lines(spark, _damaged_file(spark, sf_dir), SRC, TGT)


@register("good_lines", f"SELECT n AS row_id, coalesce(src, '') AS src, coalesce(tgt, '') AS tgt FROM ({_NUMBERED_SQL}) WHERE NOT (row_id % 7 = 3 OR row_id % 11 = 5)")
def q_good_lines(spark, sf_dir):
    """SRC-2: what is read of the same file; lines keep their positions."""
    return IO.read_pairs(spark, _damaged_file(spark, sf_dir), SRC, TGT)


# ---- every script: documents spelled in the letters of another script --------------------------------

from icx.functions.scripts import SCRIPT_RANGES  # noqa: E402

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _spelling(script: str) -> tuple[str, str]:
    """Latin letters and full stop, and what stands for them in a script."""
    lo, hi = SCRIPT_RANGES[script]
    if script == "Latn":
        return _LETTERS, _LETTERS
    stop = "\u06d4" if script == "Arab" else "." if script == "Cyrl" else "\u0964"
    return _LETTERS + ".", "".join(chr(lo + 5 + i % (hi - lo - 6)) for i in range(len(_LETTERS))) + stop


_SCRIPTS = tuple(SCRIPT_RANGES)
_SCRIPT_LINES_SQL = ("SELECT doc_id AS row_id, CASE doc_id % {n} {texts} END AS text, CASE doc_id % {n} {codes} END AS code FROM documents".format(
    n=len(_SCRIPTS),
    texts=" ".join(f"WHEN {i} THEN translate(text, {sql.lit(a)}, {sql.lit(b)})" for i, (a, b) in enumerate(map(_spelling, _SCRIPTS))),
    codes=" ".join(f"WHEN {i} THEN 'xxx_{sc}'" for i, sc in enumerate(_SCRIPTS))))


def _script_lines(spark, sf_dir):
    """Every document, spelled in the script that its id names."""
    d = tables.read(spark, sf_dir, "documents")
    which = F.col("doc_id") % len(_SCRIPTS)
    text = code = None
    for i, sc in enumerate(_SCRIPTS):
        spelled = F.translate("text", *_spelling(sc))
        text = F.when(which == i, spelled) if text is None else text.when(which == i, spelled)
        code = F.when(which == i, F.lit(f"xxx_{sc}")) if code is None else code.when(which == i, F.lit(f"xxx_{sc}"))
    return tables.spread(d.select(F.col("doc_id").alias("row_id"), text.alias("text"), code.alias("code")), "row_id", basis=d)


def _scripts_query(attack):
    def run(spark, sf_dir):
        ln = _script_lines(spark, sf_dir)
        return ln.select("row_id", "code", PT.perturb(attack, F.col("text"), [F.col("row_id")], F.col("code"), PTB_RATE, SEED).alias("perturbed"))

    return run


for _attack in ("span_noise", "punctuation_drop_attack", "punctuation_add_attack"):
    register(f"ptb_scripts_{_attack.replace('_attack', '')}",
             f"SELECT p.row_id, s.code, p.perturbed FROM ({sql.ptb_sql(_attack, _SCRIPT_LINES_SQL, ['row_id'], PTB_RATE, SEED)}) p "
             f"JOIN ({_SCRIPT_LINES_SQL}) s ON s.row_id = p.row_id")(_scripts_query(_attack))


# ---- chat rendering, language names, text functions ---------------------------------------------

from icx.functions import text as TX  # noqa: E402
from icx.functions.scripts import languages as _languages  # noqa: E402

# A user-given role -> (prefix, suffix) template; this one is a plain bracketed example.
CHAT_TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": (" ", " </s>"),
}
GENERATION_PREFIX = ""


@register("render_chat", f"""WITH msgs AS (SELECT row_id, msg_idx::INTEGER AS msg_idx, role, content FROM ({sql.few_shot_chat(TEST_SQL, DEV_SQL, K, SEED, SRC, TGT)}))
SELECT row_id, string_agg(CASE role {' '.join(f"WHEN '{r}' THEN {sql.lit(a)} || content || {sql.lit(b)}" for r, (a, b) in CHAT_TEMPLATE.items())}
       ELSE content END, '' ORDER BY msg_idx) || {sql.lit(GENERATION_PREFIX)} AS prompt FROM msgs GROUP BY row_id""")
def q_render_chat(spark, sf_dir):
    test, dev = _test_dev(spark, sf_dir)
    out = P.few_shot(D.select_demos(test, dev, K, SEED), SRC, TGT, chat=True)
    return out.select("row_id", P.render_chat(F.col("prompt"), CHAT_TEMPLATE, GENERATION_PREFIX).alias("prompt"))


@register("language_names", f"""SELECT c.code, split_part(c.code, '_', 1) AS lang, split_part(c.code, '_', 2) AS script, l.name
FROM ({_CODES_SQL}) c LEFT JOIN {_lang_values()} ON l.code = c.code""")
def q_language_names(spark, sf_dir):
    """PRJ-1/2: codes found in the data with their parts and display names (broadcast dimension)."""
    codes = _doc_codes(spark, sf_dir).distinct()
    dim = F.broadcast(_languages(spark).select("code", "name"))
    return codes.join(dim, "code", "left").select(
        "code", F.split("code", "_")[0].alias("lang"), F.element_at(F.split("code", "_"), -1).alias("script"), "name"
    )


@register("python_split", f"""SELECT doc_id AS row_id, len({sql.words('text')})::INTEGER AS n_words, length(text)::INTEGER AS n_chars,
       length({sql.strip('text')})::INTEGER AS n_stripped,
       length(regexp_replace(text, {sql.lit(TX.WS_RUN)}, '', 'g'))::INTEGER AS n_nospace,
       split_part(text, chr(10), 1) AS first_line,
       array_to_string({sql.words('text')}, ' ') = regexp_replace({sql.strip('text')}, {sql.lit(TX.WS_RUN)}, ' ', 'g') AS normalised_ok
FROM documents""")
def q_python_split(spark, sf_dir):
    """FN-1..9: Python split/strip/first-line semantics over whole documents."""
    d = tables.read(spark, sf_dir, "documents")
    t = F.col("text")
    w = TX.words(t)
    return d.select(
        F.col("doc_id").alias("row_id"), F.size(w).alias("n_words"), F.char_length(t).alias("n_chars"),
        F.char_length(TX.py_strip(t)).alias("n_stripped"), F.char_length(TX.no_space(t)).alias("n_nospace"),
        TX.first_line(t).alias("first_line"),
        (F.array_join(w, " ") == F.regexp_replace(TX.py_strip(t), TX.WS_RUN, " ")).alias("normalised_ok"),
    )


# ---- streaming -----------------------------------------------------------------------------------

from icx.functions import subword as SW  # noqa: E402
from icx.streaming import prompts as ST  # noqa: E402


@register("stream_few_shot_prompt", sql.few_shot_text(TEST_SQL, DEV_SQL, K, SEED, SRC, TGT))
def q_stream_few_shot(spark, sf_dir):
    """Test pairs land as files; a streaming query composes their prompts against the static pool."""
    test, dev = _test_dev(spark, sf_dir)
    landing = IO.scratch_dir(spark, "stream-in")
    test.write.mode("overwrite").parquet(landing)
    pool = D.Pool.build(dev)
    return ST.run_available_now(spark, landing, "row_id bigint, src string, tgt string", pool, K, SEED, SRC, TGT)


# ---- scoring whole documents (scale query; checked against brute force in tests) -------------------

def document_metrics(spark, sf_dir, rate=PTB_RATE, tokenizer="13a"):
    """How far each perturbation moves whole documents: BLEU/chrF/chrF++ of the perturbed
    text against the original, per attack, over every document in one aggregation."""
    docs = tables.read(spark, sf_dir, "documents")
    ln = docs.select(F.col("doc_id").alias("row_id"), "text", tables.lang_code_col(F.col("lang")).alias("code"))
    ln = M.deal(ln, docs)  # each text once, before the runs multiply it
    run, text = F.col("run_id"), F.col("text")
    each = ln.select(F.explode(F.array(*[F.lit(r) for r in RUNS])).alias("run_id"), "row_id", "text", "code")
    hyp = PT.perturb(F.when(run.isin(*PT.ATTACKS), run), text, [F.col("row_id")], F.col("code"), rate, SEED)
    seg = each.select("run_id", hyp.alias("hypothesis"), text.alias("reference"))
    return M.score(seg, ["run_id"], tokenizer=tokenizer, dealt=True)


# No SQL twin: the n-grams of whole documents, joined as rows, take DuckDB minutes at the
# smallest scale; tests/test_metrics.py holds the query against brute force.
register("document_metrics", None)(document_metrics)


# ---- single-metric queries and grid projections ------------------------------------------------

_SRC_AS_HYP_SQL = f"SELECT 'source_copy' AS run_id, src AS hypothesis, tgt AS reference FROM ({TEST_SQL})"


def _source_copy(spark, sf_dir):
    """The copy baseline: the untranslated source scored as the hypothesis."""
    test, _ = _test_dev(spark, sf_dir)
    return test.select(F.lit("source_copy").alias("run_id"), F.col("src").alias("hypothesis"),
                       F.col("tgt").alias("reference"))


for _metric in ("bleu", "chrf", "chrf_pp"):
    register(_metric, f"SELECT run_id, {_metric} FROM ({sql.metrics_sql(_SRC_AS_HYP_SQL, ['run_id'], '13a')})")(
        (lambda m: lambda spark, sf_dir: M.score(_source_copy(spark, sf_dir), ["run_id"], metrics=(m,)))(_metric)
    )

def bleu_subword(spark, sf_dir, vocabulary=None):
    """MET-5: BLEU of the copy baseline on subword tokens, over all pairs of the table."""
    import public_tokenizers

    ranks = SW.read_ranks(spark, vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = tables.pairs(spark, sf_dir).select(F.lit("source_copy").alias("run_id"), F.col("src").alias("hypothesis"), F.col("tgt").alias("reference"))
    made = SW.with_tokens(rows, ranks, ("hypothesis", "reference"))
    return M.score(made, ["run_id"], metrics=("bleu",), tokens=("hypothesis_tokens", "reference_tokens"))


# Merges by rank cannot be said in SQL; tests/test_subword.py holds tokens and score against the public library.
register("bleu_subword", None)(bleu_subword)


@register("run_names", f"SELECT DISTINCT experiment, src_lang, tgt_lang, run_name FROM ({_ALL_GRID_SQL})")
def q_run_names(spark, sf_dir):
    return GR.all_runs(_pairs(spark, sf_dir), SEED).select("experiment", "src_lang", "tgt_lang", "run_name").distinct()


@register("batch_sizes", f"SELECT DISTINCT experiment, shots, batch_size FROM ({_ALL_GRID_SQL})")
def q_batch_sizes(spark, sf_dir):
    return GR.all_runs(_pairs(spark, sf_dir), SEED).select("experiment", "shots", "batch_size").distinct()
