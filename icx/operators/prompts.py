"""Prompt composition (PRM-1..18) as string/array expressions.

Text form:  instruction + one block per demonstration + the open query block
    demo block  "{S}: {src}\\n{T}: {tgt}\\n\\n"
    query block "{S}: {src}\\n{T}: "          (trailing space, no newline)
Chat form:  array<struct<role, content>>: optional system message, then per
    demonstration a user turn "{S}: {src}\\n{T}: " and an assistant turn "{tgt}\\n\\n",
    then the user query turn.

A prompt any of whose texts is null is null as a whole: kept, so that it can be counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icx.functions.scripts import language_name
from icx.functions.seeded import u60

INSTRUCTION_KINDS = ("standard", "generic", "random", "contrastive", "no_instruct")

# Instruction texts of the instruction study.
GENERIC_INSTRUCTION = "Perform the task based on the examples provided:\n\n"
RANDOM_INSTRUCTIONS = [
    "Complete the description with an appropriate ending:\n\n",
    "I am hesitating between two options. Help me choose the more likely cause or effect.\n\n",
    "Generate a headline for the following article(s) as accurately as possible.\n\n",
    "Predict the sentiment of the review. The possible choices for the sentiment are: 'positive' and 'negative'.\n\n",
    "Answer whether the hypothesis is more likely to be true (entailment), false (contradiction), or unknown (neutral) based on the given premise.\n\n",
    "The following are multiple choice questions (with answers) about subjects.\n\n",
]
PIVOT_FINAL_SUFFIX = ". You should only generate the translation and do not give explanation:\n\n"

MESSAGE = "struct<role:string,content:string>"


def _joined(*parts: str | Column) -> Column:
    """Texts and columns in a row; a constant when all are texts."""
    if all(isinstance(p, str) for p in parts):
        return F.lit("".join(parts))
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def instruction(kind: str, src_name: str | Column, tgt_name: str | Column, chat: bool, seed: int, row_key: Column) -> Column | None:
    """Instruction text for a kind; None means 'no system message' (chat, no_instruct). Names may differ by row."""
    end = ".\n\n" if chat else ":\n\n"
    if kind == "standard":
        return _joined("Translate this from ", src_name, " into ", tgt_name, end)
    if kind == "generic":
        return F.lit(GENERIC_INSTRUCTION)
    if kind == "random":
        pool = F.array(*[F.lit(s) for s in RANDOM_INSTRUCTIONS])
        return F.element_at(pool, (u60(seed, "instruction", row_key) % len(RANDOM_INSTRUCTIONS) + 1).cast("int"))
    if kind == "contrastive":
        return _joined("Translate this from ", tgt_name, " into ", src_name, ".\n\n" if chat else " :\n\n")
    if kind == "no_instruct":
        return None if chat else F.lit("")
    raise ValueError(f"unknown instruction kind {kind!r}")


def _msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def demo_block(demos: Column, demo_label: str | Column, tgt_label: str | Column, demo_src: str = "src", demo_tgt: str = "tgt") -> Column:
    """The demonstrations of a text prompt; null if one lacks a text."""
    block = F.array_join(
        F.transform(
            demos,
            lambda d: F.concat(
                _joined(demo_label, ": "), d[demo_src], _joined("\n", tgt_label, ": "), d[demo_tgt], F.lit("\n\n")
            ),
        ),
        "",
    )
    return F.when(_complete(demos, demo_src, demo_tgt), block)


def text_of_block(instr: Column, block: Column, query_src: Column, query_label: str | Column, tgt_label: str | Column) -> Column:
    """A text prompt around its demonstrations, which several prompts may share."""
    return F.concat(instr, block, _joined(query_label, ": "), query_src, _joined("\n", tgt_label, ": "))


def text_prompt(instr: Column, demos: Column, query_src: Column, demo_label: str | Column, query_label: str | Column,
                tgt_label: str | Column, demo_src: str = "src", demo_tgt: str = "tgt") -> Column:
    return text_of_block(instr, demo_block(demos, demo_label, tgt_label, demo_src, demo_tgt), query_src, query_label, tgt_label)


def _complete(demos: Column, *fields: str) -> Column:
    """No demonstration lacks a text; a prompt with one left out would look like fewer shots."""
    return ~F.exists(demos, lambda d: F.coalesce(*[F.when(d[f].isNull(), F.lit(True)) for f in fields], F.lit(False)))


def chat_prompt(system: Column | None, demos: Column, query_src: Column, demo_label: str | Column, query_label: str | Column,
                tgt_label: str | Column, demo_src: str = "src", demo_tgt: str = "tgt") -> Column:
    head = F.array(_msg("system", system)) if system is not None else F.array().cast(f"array<{MESSAGE}>")
    turns = F.flatten(
        F.transform(
            demos,
            lambda d: F.array(
                _msg("user", F.concat(_joined(demo_label, ": "), d[demo_src], _joined("\n", tgt_label, ": "))),
                _msg("assistant", F.concat(d[demo_tgt], F.lit("\n\n"))),
            ),
        )
    )
    query = F.array(_msg("user", F.concat(_joined(query_label, ": "), query_src, _joined("\n", tgt_label, ": "))))
    return F.when(_complete(demos, demo_src, demo_tgt) & query_src.isNotNull(), F.concat(head, turns, query))


def few_shot(df: DataFrame, src_lang: str, tgt_lang: str, chat: bool = False, kind: str = "standard",
             seed: int = 42, key: str = "row_id", names: dict | None = None) -> DataFrame:
    """Add `prompt` from `demos` and `src` (PRM-1..7)."""
    s, t = language_name(src_lang, names), language_name(tgt_lang, names)
    instr = instruction(kind, s, t, chat, seed, F.col(key))
    if chat:
        return df.withColumn("prompt", chat_prompt(instr, F.col("demos"), F.col("src"), s, s, t))
    return df.withColumn("prompt", text_prompt(instr, F.col("demos"), F.col("src"), s, s, t))


def allied(df: DataFrame, src_lang: str, aux_lang: str, tgt_lang: str, chat: bool = False,
           names: dict | None = None) -> DataFrame:
    """Allied-task prompt (PRM-8/9): demonstrations translate AUX->T, the query S->T."""
    s, a, t = (language_name(x, names) for x in (src_lang, aux_lang, tgt_lang))
    instr = F.lit(f"Translate this into {t}:\n\n")
    build = chat_prompt if chat else text_prompt
    return df.withColumn("prompt", build(instr, F.col("demos"), F.col("src"), a, s, t))


def pivot_prompt(src: Column, pivot: Column, tgt: Column, s: str, p: str, t: str, chat: bool) -> Column:
    """Three-block pivot prompt (PRM-11) or its five-message chat form (PRM-12)."""
    if not chat:
        return F.concat(
            F.lit(f"Translate this from {s} into {p}:\n\n{s}: "), src, F.lit(f"\n{p}: "), pivot,
            F.lit(f"\n\nTranslate this from {p} into {t}:\n\n{p}: "), pivot, F.lit(f"\n{t}: "), tgt,
            F.lit(f"\n\nTranslate this from {s} into {t}:\n\n{s}: "), src, F.lit(f"\n{t}: "),
        )
    complete = src.isNotNull() & pivot.isNotNull() & tgt.isNotNull()
    return F.when(complete, F.array(
        _msg("user", F.concat(F.lit(f"Translate this from {s} into {p}:\n\n{s}: "), src, F.lit(f"\n{p}: "))),
        _msg("assistant", F.concat(pivot, F.lit("\n\n"))),
        _msg("user", F.concat(F.lit(f"Translate this from {p} into {t}:\n\n{p}: "), pivot, F.lit(f"\n{t}: "))),
        _msg("assistant", F.concat(tgt, F.lit("\n\n"))),
        _msg("user", F.concat(F.lit(f"Translate this from {s} into {t}{PIVOT_FINAL_SUFFIX}{s}: "), src,
                              F.lit(f"\n{t}: "))),
    ))


def messages_long(df: DataFrame, keys: list[str], col: str = "prompt") -> DataFrame:
    """One row per chat message: keys..., msg_idx, role, content."""
    return df.select(*keys, F.posexplode(col).alias("msg_idx", "m")).select(
        *keys, "msg_idx", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


def render_chat(messages: Column, template: dict[str, tuple[str, str]], generation_prefix: str = "") -> Column:
    """Chat list -> one string with a user-given role -> (prefix, suffix) template (PRM-18)."""
    def wrap(m):
        out = None
        for role, (pre, suf) in template.items():
            val = F.concat(F.lit(pre), m["content"], F.lit(suf))
            out = F.when(m["role"] == role, val) if out is None else out.when(m["role"] == role, val)
        return out.otherwise(m["content"])

    whole = F.concat(F.array_join(F.transform(messages, wrap), ""), F.lit(generation_prefix))
    return F.when(~F.exists(messages, lambda m: m["content"].isNull()), whole)
