"""A whole experiment grid as one job: draw, perturb, prompt, generate, clean, score.

Every run of the grid meets every test row. Demonstrations are drawn once per distinct
(pool, shots, seed), as array columns, and fetched once; runs are made from a constant
inside the row (no join with the grid), in sets that share their draw, attack and direction:
the demonstrations of a set are perturbed once for all its rates and noise types. Prompts, the
model stand-in and cleaning pick their case by the run's parameters. One aggregation, which
also counts the rows, then scores all runs where they lie.

Texts of the noise:
  homogeneous    a demonstration is perturbed by its own pool row, alike in every prompt;
  heterogeneous  by (test row, position), at the positions that the type names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icx.functions.arrays import let
from icx.functions.scripts import LANGUAGES, language_name
from icx.operators import demos as D
from icx.operators import generate as G
from icx.operators import metrics as M
from icx.operators import perturb as PT
from icx.operators import pivot as PV
from icx.operators import prompts as P
from icx.operators.segments import GatheredPools, SegmentedPool, looked_up
from icx.plans import grid as GR
from icx.session import shuffles_dropped
from icx.sources import fanout as FO
from icx.sources import io as IO

DEMO_EXPERIMENTS = ("instruction", "directionality", "homogeneous", "heterogeneous")
RUN = "struct<run_id:string,experiment:string,shots:int,kind:string,seed:int,attack:string,rate:double,direction:string,htype:string,variant:string>"


def _runs_of(src_lang: str, tgt_lang: str, experiments: tuple[str, ...], aux_lang: str | None = None, pivot_lang: str | None = None) -> Column:
    """The runs of one language pair as a constant array."""
    langs = {"src_lang": src_lang, "tgt_lang": tgt_lang, "aux_lang": aux_lang, "pivot_lang": pivot_lang}
    fields = [f.split()[0] for f in GR.GRID_SCHEMA.split(", ")]

    def ident(g: Column) -> Column:
        key = [F.lit(langs[c] or "") if c in langs else F.coalesce(g[c].cast("string"), F.lit("")) for c in GR.RUN_KEY]
        return F.md5(F.concat_ws("|", *key))

    return F.transform(GR.grid_array(experiments), lambda g: F.struct(ident(g).alias("run_id"), *[g[f].alias(f) for f in fields]).cast(RUN))


def _fetched(test: DataFrame, pool: D.Pool, draws: list[tuple[int, int]]) -> DataFrame:
    """Test rows once per draw: `draw` ('shots/seed') and `demos`, its demonstrations in order."""
    picks = F.array(*[
        F.struct(F.lit(f"{k}/{s}").alias("draw"), D.drawn(F.col("row_id"), pool.size, k, s).alias("idx")) for k, s in draws
    ])
    each = test.select("row_id", F.explode(picks).alias("p")).select("row_id", "p.draw", F.posexplode("p.idx").alias("pos", "idx"))
    side = pool.df.select("idx", "row_id", "src", "tgt").withColumnRenamed("row_id", "dev")
    side = F.broadcast(side) if pool.broadcastable() else side  # measured size
    # the runs are made from these rows: as many tasks as the session plans for a shuffle, however small the rows are
    found = each.join(side, "idx").repartition(M.tasks_of(test), "row_id")
    lists = found.groupBy("row_id", "draw").agg(F.array_sort(F.collect_list(F.struct("pos", "dev", "src", "tgt"))).alias("demos"))
    return test.join(lists, "row_id")


def _noisy(demos: Column, run: Column, row_id: Column, src_lang: str, tgt_lang: str) -> Column:
    """Demonstrations of a run with its noise."""
    alike, of_source = run["experiment"] == "homogeneous", run["direction"] == "source"

    def key(d: Column) -> Column:
        pos, k = d["pos"], run["shots"]
        hit = (
            F.when(alike, F.lit(True))
            .when(run["htype"] == "I", pos == k - 1).when(run["htype"] == "II", pos >= 1)
            .when(run["htype"] == "III", pos == 0).when(run["htype"] == "IV", pos < k - 1)
        )
        return F.when(hit, F.when(alike, d["dev"].cast("string")).otherwise(F.concat_ws("|", row_id, pos)))

    texts = F.when(run["attack"].isNotNull(), F.transform(demos, lambda d: F.when(of_source, d["src"]).otherwise(d["tgt"])))
    lang = F.when(of_source, F.lit(src_lang)).otherwise(F.lit(tgt_lang))
    noisy = PT.perturb_each(run["attack"], texts, F.transform(demos, key), lang, run["rate"], 42)
    return F.zip_with(demos, noisy, lambda d, x: F.struct(
        d["pos"].alias("pos"), F.when(of_source, x).otherwise(d["src"]).alias("src"),
        F.when(run["direction"] == "target", x).otherwise(d["tgt"]).alias("tgt")))


def _rendered(chat: Column) -> Column:
    """Messages as one string, the way a plain template would send them."""
    return F.when(~F.exists(chat, lambda m: m["content"].isNull()), F.array_join(F.transform(chat, lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), m["content"])), ""))


def _sent(text: Column, chat: Column, as_chat: bool) -> Column:
    """PRM-17: a chat model gets rendered messages, any other model the text prompt."""
    return _rendered(chat) if as_chat else text


def _sets(src_lang: str, tgt_lang: str, experiments: tuple[str, ...], aux_lang: str | None = None) -> Column:
    """The runs of one language pair in sets that share draw, experiment, attack and direction: a constant map of 'shots/seed' to
    array<struct<experiment, shots, attack, direction, runs>>."""
    langs = {"src_lang": src_lang, "tgt_lang": tgt_lang, "aux_lang": aux_lang}
    names = [f.split()[0] for f in GR.GRID_SCHEMA.split(", ")]
    sets: dict[str, dict[tuple, dict]] = {}
    for e in experiments:
        for row in GR._rows(e):
            g = dict(zip(names, row)) | {"rate_at": GR.RATES.index(row[5]) if row[5] else None}
            key = "|".join("" if (v := langs.get(c, g.get(c))) is None else str(v) for c in GR.RUN_KEY)
            g["run_id"] = hashlib.md5(key.encode()).hexdigest()
            mine = sets.setdefault(f"{g['shots']}/{g['seed']}", {})
            of = {c: g[c] for c in ("experiment", "shots", "attack", "direction")}
            mine.setdefault(tuple(of.values()), of | {"runs": []})["runs"].append({c: g[c] for c in ("run_id", "kind", "rate_at", "htype")})
    schema = "map<string,array<struct<experiment:string,shots:int,attack:string,direction:string,runs:array<struct<run_id:string,kind:string,rate_at:int,htype:string>>>>>"
    return F.from_json(F.lit(json.dumps({draw: list(x.values()) for draw, x in sets.items()})), schema)


def _noisy_at_rates(src_lang: str, tgt_lang: str) -> Column:
    """The perturbed side of `demos` for the set `of`, at all positions and rates: array<array<string>>, null without an attack.

    A text is perturbed once for all noise types of a heterogeneous set, and ranked once for all rates.
    """
    of, demos = F.col("of"), F.col("demos")
    of_source, alike = of["direction"] == "source", of["experiment"] == "homogeneous"
    texts = F.when(of["attack"].isNotNull(), F.when(of_source, F.transform(demos, lambda d: d["src"])).otherwise(F.transform(demos, lambda d: d["tgt"])))
    keys = F.when(of["attack"].isNotNull(), F.when(alike, F.transform(demos, lambda d: d["dev"].cast("string"))).otherwise(
        F.transform(demos, lambda d: F.concat_ws("|", F.col("row_id"), d["pos"]))))
    lang = F.when(of_source, F.lit(src_lang)).otherwise(F.lit(tgt_lang))
    return PT.perturb_each(of["attack"], texts, keys, lang, GR.RATES, 42)


def _demos_of(run: Column) -> Column:
    """`demos` of the set `of` as a run of the set shows them: perturbed from `noisy` at its positions."""
    of, k = F.col("of"), F.col("of")["shots"]

    def shown(d: Column, i: Column) -> Column:
        pos = d["pos"]
        hit = (
            F.when(of["experiment"] == "homogeneous", F.lit(True))
            .when(run["htype"] == "I", pos == k - 1).when(run["htype"] == "II", pos >= 1)
            .when(run["htype"] == "III", pos == 0).when(run["htype"] == "IV", pos < k - 1)
        )
        noisy = F.get(F.get(F.col("noisy"), run["rate_at"]), i)
        return F.struct(pos.alias("pos"), F.when(hit & (of["direction"] == "source"), noisy).otherwise(d["src"]).alias("src"),
                        F.when(hit & (of["direction"] == "target"), noisy).otherwise(d["tgt"]).alias("tgt"))

    plain = F.transform("demos", lambda d: F.struct(d["pos"].alias("pos"), d["src"].alias("src"), d["tgt"].alias("tgt")))
    return F.when(of["attack"].isNull(), plain).otherwise(F.transform("demos", shown))


def prompts(test: DataFrame, dev: DataFrame, aux_dev: DataFrame, triples: DataFrame, src_lang: str, tgt_lang: str, aux_lang: str,
            pivot_lang: str, model: str = GR.DEFAULT_MODEL) -> DataFrame:
    """(run_id, experiment, row_id, prompt, reference) of every run of one language pair.

    Pivot runs have one row per triple, with `row_id` the row of its first pair and
    `part` the row of its second; all others have `part` null.
    """
    as_chat = model in GR.CHAT_MODELS
    s, t, a = language_name(src_lang), language_name(tgt_lang), language_name(aux_lang)
    draws = sorted({(k, seed) for e in DEMO_EXPERIMENTS for _, k, _, seed, *_ in GR._rows(e)})
    row, src = F.col("row_id"), F.col("src")

    def asked_of(rows: DataFrame, prompt: Callable[[Column], Column]) -> DataFrame:
        """One row per run of a set, with its prompt; the texts of a set are not copied for its runs."""
        made = rows.select("of.experiment", "row_id", "tgt", F.explode(F.transform("of.runs", lambda r: F.struct(r["run_id"].alias("run_id"), prompt(r).alias("prompt")))).alias("r"))
        return made.select("r.run_id", "experiment", "row_id", F.lit(None).cast("long").alias("part"), "r.prompt", F.col("tgt").alias("reference"))

    def sets_of(rows: DataFrame, sets: Column) -> DataFrame:
        return rows.select("row_id", "src", "tgt", "demos", F.explode(F.try_element_at(sets, F.col("draw"))).alias("of"))

    # runs whose demonstrations come from the pair's own pool
    base = _fetched(test, D.Pool.build(dev, cols=("row_id", "src", "tgt")), draws)
    rows = sets_of(base, _sets(src_lang, tgt_lang, DEMO_EXPERIMENTS)).withColumn("noisy", _noisy_at_rates(src_lang, tgt_lang))

    def head(kind: Column, chat: bool) -> Column:
        out = P.instruction("standard", s, t, chat, 42, row)
        for k in P.INSTRUCTION_KINDS[1:]:
            if (instr := P.instruction(k, s, t, chat, 42, row)) is not None:
                out = F.when(kind == k, instr).otherwise(out)
        return out

    def own_prompt(r: Column) -> Column:
        def around(demos: Column) -> Column:
            if not as_chat:
                return P.text_prompt(head(r["kind"], False), demos, src, s, s, t)
            bare, led = (_rendered(P.chat_prompt(system, demos, src, s, s, t)) for system in (None, head(r["kind"], True)))
            return F.when(r["kind"] == "no_instruct", bare).otherwise(led)

        return let(_demos_of(r), around)

    own = asked_of(rows, own_prompt)
    # the allied task draws from a pool that shares only the target language
    allied_draws = sorted({(k, seed) for _, k, _, seed, *_ in GR._rows("allied")})
    helped = sets_of(_fetched(test, D.Pool.build(aux_dev, cols=("row_id", "src", "tgt")), allied_draws), _sets(src_lang, tgt_lang, ("allied",), aux_lang))
    instr, demos = F.lit(f"Translate this into {t}:\n\n"), F.col("demos")
    allied = asked_of(helped, lambda r: _sent(P.text_prompt(instr, demos, src, a, s, t), P.chat_prompt(instr, demos, src, a, s, t), as_chat))
    # the pivot study has its own rows
    names = [language_name(x) for x in (src_lang, tgt_lang, pivot_lang)]
    out = own.unionByName(allied)
    for variant in PV.VARIANTS:
        v = PV.variant_texts(triples, variant, 42)
        text, chat = (PV.pivot_prompt(F.col("src"), F.col("pivot"), F.col("tgt"), *names, c) for c in (False, True))
        mine = F.filter(_runs_of(src_lang, tgt_lang, ("pivot",), pivot_lang=pivot_lang), lambda r: r["variant"] == variant)[0]
        out = out.unionByName(v.select(
            mine["run_id"].alias("run_id"), F.lit("pivot").alias("experiment"), F.col("sp_id").alias("row_id"), F.col("pt_id").alias("part"),
            _sent(text, chat, as_chat).alias("prompt"), F.col("tgt").alias("reference")))
    return out


PAIR = ("src_lang", "tgt_lang")


def prompts_of_pairs(test: DataFrame, dev: DataFrame, experiments: tuple[str, ...] = DEMO_EXPERIMENTS, noise: bool = True,
                     model: str = GR.DEFAULT_MODEL) -> DataFrame:
    """(run_id, src_lang, tgt_lang, experiment, row_id, shots, prompt, reference) of the runs of every language pair.

    `test` and `dev` hold all pairs: (src_lang, tgt_lang, row_id, src, tgt). One segmented
    index serves the draws of all pairs, shot counts and seeds; the runs that share a draw
    are exploded inside its rows, after the draw and without a join with the grid. Pairs
    without enough demonstrations have no such runs. `noise` False leaves out perturbed runs.
    """
    pool = SegmentedPool(dev, PAIR)
    return _prompts_of_rows(pool.fetched(pool.drawn(test, _draws(experiments, noise))), experiments, noise, model)


def _draws(experiments: tuple[str, ...], noise: bool) -> list[tuple[int, int]]:
    return sorted({(r[1], r[3]) for e in experiments for r in GR._rows(e) if noise or r[4] is None})


#: Texts that test rows ask for in one wave, at least; else as many bytes as the gathered texts have.
WAVE_BYTES = 64 << 20


def outcome_of_sentences(sentences: DataFrame, wanted: DataFrame, is_test: Column, outcome: Callable[[DataFrame], DataFrame],
                         experiments: tuple[str, ...] = DEMO_EXPERIMENTS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """What `outcome` makes of the text prompts of all unperturbed runs, over the fan-out of all sentences, in waves of test rows.

    The prompts are those of `prompts_of_pairs`. They hold every text dozens of times, and a prompt
    needs its texts in one place. So the test rows are dealt into waves, by id, whose texts are about
    as large as the gathered texts (or `wave_bytes`); their draws are written once, as keys. Each wave
    fetches, prompts and writes its outcome, and its exchange is dropped before the next. The rows of all waves together are returned.

    `outcome` gets each prompt once, with its length and the runs that send it: (src_lang, tgt_lang,
    row_id, shots, prompt, n_chars, reference, runs: array<struct<run_id, experiment>>).
    """
    spark = sentences.sparkSession
    path = IO.scratch_dir(spark, "study")
    with shuffles_dropped(spark):
        text = lambda s: F.struct(s["code"].alias("code"), s["text"].alias("text"), F.char_length(s["text"]).cast("long").alias("chars"))
        rows = FO.gathered(sentences, wanted).withColumn("in_all", F.transform("in_all", text))
        rows.write.parquet(f"{path}/gathered")
        rows = spark.read.schema(rows.schema).parquet(f"{path}/gathered")
        pools = GatheredPools(rows, wanted, is_test, _draws(experiments, False))
        held, asked = pools.nbytes()
        waves = max(1, -(-asked // max(held, wave_bytes)))
        requests = pools.requests().withColumn("wave", F.pmod(F.xxhash64("row_id"), F.lit(waves)).cast("int"))
        requests.write.partitionBy("wave").parquet(f"{path}/requests")
        requests = spark.read.schema(requests.schema).parquet(f"{path}/requests")
        for w in range(waves):
            mine = requests.filter(F.col("wave") == w).drop("wave")
            out = outcome(_prompts_with_runs(pools.fetched(mine), experiments))
            out.write.parquet(f"{path}/wave-{w}")
    return spark.read.schema(out.schema).parquet(*[f"{path}/wave-{w}" for w in range(waves)])


def _own_runs(experiments: tuple[str, ...], noise: bool) -> Column:
    """The runs of a row's language pair, shots and seed."""
    fields = [f.split()[0] for f in GR.GRID_SCHEMA.split(", ")]
    own = {"src_lang": F.col("src_lang"), "tgt_lang": F.col("tgt_lang"), "aux_lang": F.lit(""), "pivot_lang": F.lit("")}

    def ident(g: Column) -> Column:
        return F.md5(F.concat_ws("|", *[own[c] if c in own else F.coalesce(g[c].cast("string"), F.lit("")) for c in GR.RUN_KEY]))

    here = F.filter(GR.grid_array(experiments, noise), lambda g: (g["shots"] == F.col("shots")) & (g["seed"] == F.col("seed")))
    return F.transform(here, lambda g: F.struct(ident(g).alias("run_id"), *[g[f].alias(f) for f in fields]).cast(RUN))


def _named(rows: DataFrame) -> DataFrame:
    """Rows with the names of their languages, `_s` and `_t`."""
    src, tgt = F.col("src_lang"), F.col("tgt_lang")
    return rows.withColumns({"_s": F.coalesce(looked_up(LANGUAGES, src), src), "_t": F.coalesce(looked_up(LANGUAGES, tgt), tgt)})


def _head(kind: Column, s: Column, t: Column) -> Column:
    """The instruction of a text prompt; a run without a kind has the standard one."""
    head = P.instruction("standard", s, t, False, 42, F.col("row_id"))
    for k in P.INSTRUCTION_KINDS[1:]:
        head = F.when(kind == k, P.instruction(k, s, t, False, 42, F.col("row_id"))).otherwise(head)
    return head


def _prompts_with_runs(rows: DataFrame, experiments: tuple[str, ...]) -> DataFrame:
    """The text prompts of unperturbed runs, each once: prompts of a draw share its demonstrations and differ by kind.

    A prompt is as long as its texts, whose lengths are known, and the same prompt around empty texts.
    """
    s, t, none = F.col("_s"), F.col("_t"), F.lit("")
    empty = F.transform("demos", lambda d: F.struct(none.alias("src"), none.alias("tgt")))
    rows = _named(rows).withColumns({"block": P.demo_block(F.col("demos"), s, t), "frame": P.demo_block(empty, s, t),
                                     "own": _own_runs(experiments, False)}).drop("demos")

    def runs(kind: str) -> Column:
        mine = F.filter("own", lambda r: F.coalesce(r["kind"], F.lit(P.INSTRUCTION_KINDS[0])) == kind)
        return F.transform(mine, lambda r: F.struct(r["run_id"].alias("run_id"), r["experiment"].alias("experiment")))

    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), runs(k).alias("runs")) for k in P.INSTRUCTION_KINDS])
    rows = rows.withColumn("of", F.explode(F.filter(kinds, lambda k: F.size(k["runs"]) > 0)))  # inside: of a column, Spark would make the runs again to look for empty arrays
    head = _head(F.col("of.kind"), s, t)
    prompt = P.text_of_block(head, F.col("block"), F.col("src"), s, t)
    n_chars = F.char_length(P.text_of_block(head, F.col("frame"), none, s, t)) + F.col("chars")
    return rows.select(*PAIR, "row_id", "shots", prompt.alias("prompt"), n_chars.alias("n_chars"), F.col("tgt").alias("reference"), "of.runs")


def _prompts_of_rows(rows: DataFrame, experiments: tuple[str, ...], noise: bool, model: str) -> DataFrame:
    as_chat = model in GR.CHAT_MODELS
    src, tgt, row = F.col("src_lang"), F.col("tgt_lang"), F.col("row_id")
    runs = _own_runs(experiments, noise)
    rows = rows.withColumn("run", F.explode(runs))
    run, demos = F.col("run"), F.col("demos")
    if noise:
        plain = F.transform(demos, lambda d: F.struct(d["pos"].alias("pos"), d["src"].alias("src"), d["tgt"].alias("tgt")))
        rows = rows.withColumn("demos", F.when(run["attack"].isNull(), plain).otherwise(_noisy(demos, run, row, src, tgt)))
    rows = _named(rows)
    s, t = F.col("_s"), F.col("_t")
    if as_chat:
        chat = lambda kind: P.chat_prompt(P.instruction(kind, s, t, True, 42, row), demos, F.col("src"), s, s, t)
        prompt = _rendered(chat("standard"))
        for kind in P.INSTRUCTION_KINDS[1:]:
            prompt = F.when(run["kind"] == kind, _rendered(chat(kind))).otherwise(prompt)
    else:
        prompt = P.text_prompt(_head(run["kind"], s, t), demos, F.col("src"), s, s, t)
    return rows.select("run.run_id", *PAIR, "run.experiment", "row_id", "shots", prompt.alias("prompt"), F.col("tgt").alias("reference"))


def predictions(asked: DataFrame, context: int) -> DataFrame:
    """Prompts with the stand-in model's cleaned answer: the reference, unless the prompt is too long."""
    fits = (F.octet_length("prompt") <= context) | (F.char_length("prompt") <= context)  # bytes are known, characters are counted
    raw = F.when(fits, G.echo_stand_in(F.col("prompt"), F.col("reference")))
    return asked.withColumn("hypothesis", G.clean(raw, F.col("prompt")))


def scores(predicted: DataFrame) -> DataFrame:
    """One row per run: rows, answered rows and the three metrics."""
    counts = {"n_rows": F.lit(1), "n_answered": F.col("hypothesis").isNotNull()}
    out = M.score(predicted, ["run_id", "experiment"], counts=counts, dealt=True)
    return out.select("run_id", *M.METRICS, "experiment", *counts)
