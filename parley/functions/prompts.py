"""Prompts and model answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parley.functions.text import LINE_BREAK, blank_to_null, let, strip

# Names of the three holes in a prompt template.
PLACEHOLDERS = ("source_text", "source_language", "target_language")
PARSE_FAILED = "(parse failed)"


def render_prompt(
    template: Column, source_text: Column, source_language: Column, target_language: Column,
    system: Column | None = None,
) -> Column:
    """Fill the holes of a template; a system text goes in front, with a blank line between."""
    # The text goes in last: what it says must not be taken for a hole.
    out = F.replace(template, F.lit("{source_language}"), source_language)
    out = F.replace(out, F.lit("{target_language}"), target_language)
    out = F.replace(out, F.lit("{source_text}"), source_text)
    return out if system is None else F.concat_ws("\n\n", blank_to_null(system), out)


def parse_tagged_lines(answer: Column, tag: str, source_tag: str = "EN") -> Column:
    """Struct (source_phrase, translated): the last ``EN:`` line and the last ``<tag>:`` line.

    Without either the first 200 characters stand in for the source and the translation says that
    parsing failed.
    """
    split_lines = F.transform(F.split(strip(F.coalesce(answer, F.lit(""))), LINE_BREAK), strip)

    def last(lines: Column, t: str) -> Column:
        pattern = f"(?i)^{t}:\\s*(.*)$"
        hit = F.try_element_at(F.filter(lines, lambda s: s.rlike(pattern)), F.lit(-1))
        return F.coalesce(strip(F.regexp_extract(hit, pattern, 1)), F.lit(""))

    def parts(found: Column) -> Column:
        src, dst = found["src"], found["dst"]
        failed = (src == "") & (dst == "")
        return F.struct(
            F.when(failed, F.substring(answer, 1, 200)).when(src == "", answer).otherwise(src).alias("source_phrase"),
            F.when(failed, F.lit(PARSE_FAILED)).otherwise(dst).alias("translated"),
        )

    both = lambda lines: F.struct(last(lines, source_tag).alias("src"), last(lines, tag).alias("dst"))
    return let(let(split_lines, both), parts)


def prediction_shape(answer: Column) -> Column:
    """Struct (label, score) out of the JSON shapes a classifier may answer with.

    Tried in order: ``labels`` with (label, score) pairs, ``labels`` next to ``scores``,
    ``emotion`` with ``score``, and a text under ``text``, ``pred`` or ``predict``.  A list stands
    for its first item.
    """
    item = F.when(F.ltrim(answer).startswith("["), F.get_json_object(answer, "$[0]")).otherwise(answer)

    def at(path: str) -> Column:
        return F.get_json_object(item, path)

    def num(path: str, default: float | None = 1.0) -> Column:
        v = at(path).try_cast("double")
        return v if default is None else F.coalesce(v, F.lit(default))

    first = at("$.labels[0]")
    is_pair = first.startswith("[") & at("$.labels[0][1]").isNotNull()
    plain = [
        F.when(at(f"$.{k}").isNotNull(), F.struct(
            F.lower(at(f"$.{k}")).alias("label"),
            F.coalesce(num("$.score", None), num("$.confidence", None), F.lit(1.0)).alias("score"),
        ))
        for k in ("text", "pred", "predict")
    ]
    return F.coalesce(
        F.when(is_pair, F.struct(F.lower(at("$.labels[0][0]")).alias("label"), num("$.labels[0][1]").alias("score"))),
        F.when(first.isNotNull() & ~first.startswith("["),
               F.struct(F.lower(first).alias("label"), num("$.scores[0]").alias("score"))),
        F.when(at("$.emotion").isNotNull(),
               F.struct(F.lower(at("$.emotion")).alias("label"), num("$.score").alias("score"))),
        *plain,
        F.struct(F.lit("unknown").alias("label"), F.lit(0.0).alias("score")),
    )


def rich_line(label: Column, gender: Column, emotion: Column, text: Column, is_event: Column) -> Column:
    """Display line of a segment: ``[label — estimated g, emotion]: text`` or ``[event]``."""
    event = F.concat(F.lit("["), F.coalesce(blank_to_null(text), F.lit("event")), F.lit("]"))
    talk = F.concat(F.lit("["), label, F.lit(" — estimated "), gender, F.lit(", "), emotion, F.lit("]: "),
                    strip(F.coalesce(text, F.lit(""))))
    return F.when(is_event, event).otherwise(talk)


def speaker_sentence(label: Column, gender: Column, emotion: Column, seconds: Column) -> Column:
    """One spoken sentence about a speaker (whole seconds, halves to even)."""
    return F.concat(
        label, F.lit(", estimated "), gender, F.lit(", spoke for about "),
        F.bround(seconds, 0).cast("long").cast("string"), F.lit(" seconds and appeared mostly "), emotion, F.lit("."),
    )


def summary_opening(language: Column, speakers: Column) -> Column:
    plural = F.when(speakers == 1, F.lit(" was")).otherwise(F.lit("s were"))
    return F.concat(F.lit("The conversation was in "), language, F.lit(". "), speakers.cast("string"),
                    F.lit(" speaker"), plural, F.lit(" detected."))
