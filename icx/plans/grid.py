"""Experiment grids (GRD-1..8), run names (PRJ-5), parameter names (PRJ-4), batch sizes.

A grid is a small DataFrame of run parameters; crossing it with the language pairs
present in the data gives one row per run, so a whole study is one DataFrame keyed by
`run_id` instead of hundreds of separate processes (`run_name` is for people: it leaves
out the seed and the direction). Grid tables are bounded by the
parameter lists (at most a few hundred rows), so joining them is broadcast-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icx.functions.arrays import let
from icx.functions.seeded import u60
from icx.functions.text import basename
from icx.operators.perturb import ATTACKS, RATE_PARAM
from icx.operators.prompts import INSTRUCTION_KINDS

# The study's parameter lists.
SHOTS = (1, 4, 8)
HETERO_SHOTS = (4, 8)
SEEDS = (0, 25, 42)
RATES = (0.1, 0.25, 0.5, 0.75)
HETERO_ATTACKS = ("span_noise", "word_duplication", "ocr", "word_order")
HETERO_TYPES = ("I", "II", "III", "IV")
DIRECTIONS = ("source", "target")
PIVOT_VARIANTS = ("I", "II", "III", "IV")
BATCH_SIZES = {1: 32, 4: 24, 8: 16}
HETERO_BATCH_SIZES = {1: 16, 4: 8, 8: 8}
PIVOT_BATCH_SIZE = 16
CHAT_MODELS = ("meta-llama/Llama-2-7b-chat-hf",)
DEFAULT_MODEL = "meta-llama/Llama-2-7b-chat-hf"

GRID_SCHEMA = (
    "experiment string, shots int, kind string, seed int, attack string, rate double, "
    "direction string, htype string, variant string"
)


def _rows(experiment: str) -> list[tuple]:
    e = experiment
    if e == "instruction":
        return [(e, k, kind, 42, None, None, None, None, None) for k in SHOTS for kind in INSTRUCTION_KINDS]
    if e == "directionality":
        return [(e, k, None, s, None, None, None, None, None) for k in SHOTS for s in SEEDS]
    if e == "homogeneous":
        clean = [(e, k, None, 42, None, None, None, None, None) for k in SHOTS]
        noisy = [(e, k, None, 42, a, r, d, None, None) for k in SHOTS for a in ATTACKS for r in RATES for d in DIRECTIONS]
        return clean + noisy
    if e == "heterogeneous":
        return [(e, k, None, 42, a, r, d, t, None) for k in HETERO_SHOTS for a in HETERO_ATTACKS for r in RATES
                for t in HETERO_TYPES for d in DIRECTIONS]
    if e == "allied":
        return [(e, k, None, 42, None, None, None, None, None) for k in SHOTS]
    if e == "pivot":
        return [(e, 0, None, 42, None, None, None, None, v) for v in PIVOT_VARIANTS]
    raise ValueError(f"unknown experiment {experiment!r}")


EXPERIMENTS = ("instruction", "directionality", "homogeneous", "heterogeneous", "allied", "pivot")


def param_name(attack: Column) -> Column:
    """PRJ-4: the keyword a rate is passed under for each attack."""
    out = None
    for a, p in RATE_PARAM.items():
        out = F.when(attack == a, F.lit(p)) if out is None else out.when(attack == a, F.lit(p))
    return out


def batch_size(experiment: Column, shots: Column) -> Column:
    """GRD-7: batch size by shot count; an unmapped shot count fails the job."""
    def lookup(table):
        out = None
        for k, b in table.items():
            out = F.when(shots == k, F.lit(b)) if out is None else out.when(shots == k, F.lit(b))
        return out.otherwise(F.raise_error(F.concat(F.lit("no batch size is set for this number of shots: "), shots.cast("string"))).cast("int"))

    return (
        F.when(experiment == "pivot", F.lit(PIVOT_BATCH_SIZE))
        .when(experiment == "heterogeneous", lookup(HETERO_BATCH_SIZES))
        .otherwise(lookup(BATCH_SIZES))
    )


def run_name(model: Column, experiment: Column, src: Column, tgt: Column, aux: Column, pivot: Column,
             shots: Column, kind: Column, attack: Column, rate: Column, htype: Column, variant: Column) -> Column:
    """PRJ-5: `basename(model)-src-tgt-{k}shot[...]` per experiment."""
    m = basename(model)
    base = F.concat_ws("-", m, src, tgt, F.concat(shots.cast("string"), F.lit("shot")))
    attack_part = F.when(attack.isNull(), F.lit("clean")).otherwise(
        F.concat(attack, F.lit("-"), param_name(attack), F.lit("_"), rate.cast("string"))
    )
    return (
        F.when(experiment == "instruction", F.concat_ws("-", base, kind))
        .when(experiment == "directionality", base)
        .when(experiment == "homogeneous", F.concat_ws("-", base, attack_part))
        .when(experiment == "heterogeneous", F.concat_ws("-", base, attack_part, F.lit("heterogeneous"), htype))
        .when(experiment == "allied", F.concat_ws("-", m, src, aux, tgt, F.concat(shots.cast("string"), F.lit("shot"))))
        .otherwise(F.concat_ws("-", m, src, pivot, tgt, F.lit("variant"), variant))
    )


#: What tells two runs apart; `run_name` leaves out the seed and the direction.
RUN_KEY = ("experiment", "src_lang", "tgt_lang", "aux_lang", "pivot_lang", "shots", "kind", "seed", "attack", "rate", "direction", "htype", "variant")


def run_id() -> Column:
    """Identifier of a run: a hash of all its parameters."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RUN_KEY]))


def all_runs(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """The six experiments over all language pairs; the allied one once per distinct helper language."""
    aux = allied_choices(pairs, seed).select("src_lang", "tgt_lang", "aux_lang").filter(F.col("aux_lang").isNotNull()).distinct()
    other = pairs.filter((F.col("src_lang") != "eng_Latn") & (F.col("tgt_lang") != "eng_Latn"))
    plain = runs(pairs, ("instruction", "directionality", "homogeneous", "heterogeneous"))
    return plain.unionByName(runs(aux, ("allied",))).unionByName(runs(other.withColumn("pivot_lang", F.lit("eng_Latn")), ("pivot",)))


def grid_array(experiments: tuple[str, ...], noise: bool = True) -> Column:
    """All grid points of the experiments, or the unperturbed ones, as one constant array<struct> (bounded by the lists).

    Built from a single JSON literal that Catalyst folds once, not one literal per field.
    """
    import json

    names = [f.split()[0] for f in GRID_SCHEMA.split(", ")]
    rows = [dict(zip(names, row)) for e in experiments for row in _rows(e) if noise or row[4] is None]
    schema = "array<struct<" + ",".join(f.replace(" ", ":") for f in GRID_SCHEMA.split(", ")) + ">>"
    return F.from_json(F.lit(json.dumps(rows)), schema)


def runs(pairs: DataFrame, experiments: tuple[str, ...] = EXPERIMENTS, model: str = DEFAULT_MODEL) -> DataFrame:
    """One row per run: every grid point for every language pair (src_lang, tgt_lang[, aux_lang, pivot_lang]).

    The grid is exploded from a literal array per pair — a Generate, no join.
    """
    for c in ("aux_lang", "pivot_lang"):
        if c not in pairs.columns:
            pairs = pairs.withColumn(c, F.lit(None).cast("string"))
    j = pairs.select("*", F.explode(grid_array(experiments)).alias("g")).select(
        "src_lang", "tgt_lang", "aux_lang", "pivot_lang", "g.*"
    )
    name = run_name(F.lit(model), F.col("experiment"), F.col("src_lang"), F.col("tgt_lang"), F.col("aux_lang"),
                    F.col("pivot_lang"), F.col("shots"), F.col("kind"), F.col("attack"), F.col("rate"),
                    F.col("htype"), F.col("variant"))
    return j.select(
        "experiment", "src_lang", "tgt_lang", "aux_lang", "pivot_lang", "shots", "kind", "seed", "attack", "rate",
        "direction", "htype", "variant",
        param_name(F.col("attack")).alias("param"),
        name.alias("run_name"),
        run_id().alias("run_id"),
        batch_size(F.col("experiment"), F.col("shots")).alias("batch_size"),
        F.lit(model in CHAT_MODELS).alias("chat_format"),
    )


def language_pairs(codes: DataFrame, col: str = "code") -> DataFrame:
    """Ordered pairs of distinct language codes present in `codes`.

    The distinct set is bounded by the language dimension (hundreds at most); it is
    gathered with one partially aggregated `collect_set` and paired inside the row.
    """
    s = codes.select(F.array_sort(F.collect_set(col)).alias("c"))
    pairs = s.select(F.explode(F.flatten(F.transform(
        "c", lambda a: F.transform(F.filter("c", lambda b: b != a), lambda b: F.struct(a.alias("src_lang"), b.alias("tgt_lang")))
    ))).alias("p"))
    return pairs.select("p.*")


def _pick_excluding(codes: Column, r_hash: Column, src: Column, tgt: Column) -> Column:
    """Uniform pick from the sorted array `codes` minus {src, tgt}: r = hash mod (L - excluded),
    then step over the excluded positions in ascending order (exact, no rejection).
    Null when the array is null or nothing is left."""

    def with_pos(P):
        s_, t_ = P["s"] - 1, P["t"] - 1  # -1 when absent
        lo = F.when((s_ >= 0) & (t_ >= 0), F.least(s_, t_)).when(s_ >= 0, s_).when(t_ >= 0, t_)
        hi = F.when((s_ >= 0) & (t_ >= 0) & (s_ != t_), F.greatest(s_, t_))
        return let(F.struct(P["c"].alias("c"), lo.alias("lo"), hi.alias("hi")), with_bounds)

    def with_bounds(B):
        n_ex = F.when(B["lo"].isNotNull(), 1).otherwise(0) + F.when(B["hi"].isNotNull(), 1).otherwise(0)
        avail = F.size(B["c"]) - n_ex
        r = F.when(avail > 0, r_hash % avail)
        i1 = F.when(B["lo"].isNotNull() & (r >= B["lo"]), r + 1).otherwise(r)
        i2 = F.when(B["hi"].isNotNull() & (i1 >= B["hi"]), i1 + 1).otherwise(i1)
        return F.when(avail > 0, F.get(B["c"], i2.cast("int")))

    return let(F.struct(codes.alias("c"), F.array_position(codes, src).alias("s"), F.array_position(codes, tgt).alias("t")), with_pos)


def _dimension(codes: list[str]) -> Column:
    """The language dimension as one constant: script -> its codes in order, and '' -> all codes.

    A single literal that Catalyst folds once; a row looks its candidate list up in it.
    """
    import json

    from icx.functions.scripts import script_of

    lists: dict[str, list[str]] = {"": sorted(codes)}
    for c in sorted(codes):
        lists.setdefault(script_of(c), []).append(c)
    return F.from_json(F.lit(json.dumps(lists)), "map<string,array<string>>")


def allied_choices(pairs: DataFrame, seed: int = 42, mapping: dict[str, str] | None = None) -> DataFrame:
    """GRD-8: auxiliary language per (src, tgt) for the four allied-language choices.

    same  aux = src;  english  aux = eng_Latn;  same_script  a uniformly drawn other
    language written in the source's script;  random  a uniformly drawn other language.
    Candidate lists come from the language dimension at plan time; the draw is keyed
    by (seed, src, tgt) like every other random choice.
    """
    from icx.functions.scripts import LANGUAGES

    dimension = _dimension(list(mapping or LANGUAGES))
    src, tgt = F.col("src_lang"), F.col("tgt_lang")
    own_script = F.try_element_at(dimension, F.element_at(F.split(src, "_"), -1))
    same_script = _pick_excluding(own_script, u60(seed, "allied_script", src, tgt), src, tgt)
    rnd = _pick_excluding(F.try_element_at(dimension, F.lit("")), u60(seed, "allied_random", src, tgt), src, tgt)
    choices = F.array(
        F.struct(F.lit("same").alias("choice"), src.alias("aux_lang")),
        F.struct(F.lit("english").alias("choice"), F.lit("eng_Latn").alias("aux_lang")),
        F.struct(F.lit("same_script").alias("choice"), same_script.alias("aux_lang")),
        F.struct(F.lit("random").alias("choice"), rnd.alias("aux_lang")),
    )
    return pairs.select("src_lang", "tgt_lang", F.explode(choices).alias("x")).select("src_lang", "tgt_lang", "x.*")
