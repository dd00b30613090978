"""Assembly of activities, gaps and constructed items from a plan's slots and a model's drafts.

A draft's blank parts are replaced by what the slot itself says, never by text that fits any lesson, and each replacement leaves
its code in `notes`, in the order of the parts; what cannot be saved has a `refused` code and no parts. Everything is a fold over the columns
of one row, so no row needs another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .allocation import rubric_ladder

_TEXTS = "array<string>"
#: Minutes of an activity that are not its run; levels of a ladder from the top down.
FRAME_MINUTES = 4
LEVELS = ("complete", "mostly there", "begun", "barely begun")


def said(text: Column) -> Column:
    """A text without blanks at its ends; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def said_all(texts: Column) -> Column:
    """The texts of a list that say something, trimmed; an empty list for null."""
    return F.coalesce(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != ""), F.array().cast(_TEXTS))


def notes_of(*pairs: tuple[Column, str]) -> Column:
    """The codes of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(when, F.lit(code)) for when, code in pairs]), lambda c: c.isNotNull())


def activities(slots: DataFrame) -> DataFrame:
    """Activities from slots (package_id, activity_id, type, minutes, period_title, names of its concepts) and drafts (title, steps, criteria, support, extension).

    Adds notes: STEPS_DERIVED, CRITERIA_DERIVED, SCAFFOLD_DERIVED. The subject is the concepts' names, else the period's title.
    """
    names = F.coalesce("names", F.array().cast(_TEXTS))
    subject = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.col("period_title"))
    readable = F.translate("type", "_", " ")
    steps, criteria, support, extension = said_all(F.col("steps")), said_all(F.col("criteria")), said(F.col("support")), said(F.col("extension"))
    run = F.greatest(F.col("minutes") - FRAME_MINUTES, F.lit(1)).cast("string")
    own_steps = F.array(F.concat(F.lit("Prepare the "), readable, F.lit(" on "), subject), F.concat(F.lit("Let it run "), run, F.lit(" minutes and listen at each table")), F.concat(F.lit("Collect two answers on "), subject, F.lit(" and correct one mistake")))
    own_criteria = F.array(F.concat(F.lit("Every group says in its own words what "), F.coalesce(F.get(names, F.lit(0)), subject), F.lit(" is")), F.lit("Every group hands its result in on time"))
    return slots.select(
        "package_id", "activity_id", "type", "minutes", F.coalesce(said(F.col("title")), F.concat(F.initcap(readable), F.lit(": "), subject)).alias("title"),
        F.when(F.size(steps) > 0, steps).otherwise(own_steps).alias("steps"), F.when(F.size(criteria) > 0, criteria).otherwise(own_criteria).alias("criteria"),
        F.coalesce(support, F.concat(F.lit("Show one finished example of "), subject)).alias("support"), F.coalesce(extension, F.concat(F.lit("Find a case in which "), subject, F.lit(" comes out differently"))).alias("extension"),
        notes_of((F.size(steps) == 0, "STEPS_DERIVED"), (F.size(criteria) == 0, "CRITERIA_DERIVED"), (support.isNull() | extension.isNull(), "SCAFFOLD_DERIVED")).alias("notes"),
    )


def gaps(seeds: DataFrame) -> DataFrame:
    """Gaps from seeds (package_id, gap_id, known: the source's misconception, correction) and drafts (misconception, diagnostics (question, reveals, wrong), remediation (action, rationale, minutes)).

    Diagnostics without a question and steps without an action go. Without a step the source's own correction is one, noted CORRECTION_USED. refused:
    NO_MISCONCEPTION, NO_DIAGNOSTIC, NO_REMEDIATION, the first that holds.
    """
    belief = F.coalesce(said(F.col("misconception")), said(F.col("known")))
    asked = F.filter("diagnostics", lambda d: said(d["question"]).isNotNull())
    asked = F.transform(asked, lambda d: F.struct(F.trim(d["question"]).alias("question"), F.coalesce(said(d["reveals"]), F.concat(F.lit("Still believes: "), belief)).alias("reveals"), said(d["wrong"]).alias("wrong")))
    acted = F.filter("remediation", lambda r: said(r["action"]).isNotNull())
    acted = F.transform(acted, lambda r: F.struct(F.trim(r["action"]).alias("action"), F.coalesce(said(r["rationale"]), F.concat(F.lit("Answers: "), belief)).alias("rationale"), F.when(r["minutes"] >= 1, r["minutes"]).alias("minutes")))
    correction = said(F.col("correction"))
    stated = F.array(F.struct(correction.alias("action"), F.lit("The source corrects it so").alias("rationale"), F.lit(None).cast("int").alias("minutes")))
    s = seeds.select("package_id", "gap_id", belief.alias("misconception"), asked.alias("asked"), acted.alias("acted"), correction.alias("c"), stated.alias("stated"))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    bare = none("acted") & F.col("c").isNotNull()
    refused = F.when(F.col("misconception").isNull(), "NO_MISCONCEPTION").when(none("asked"), "NO_DIAGNOSTIC").when(none("acted") & F.col("c").isNull(), "NO_REMEDIATION")
    s = s.withColumn("refused", refused)
    kept = lambda c: F.when(F.col("refused").isNull(), c)
    return s.select(
        "package_id", "gap_id", "refused", kept(F.col("misconception")).alias("misconception"), kept(F.col("asked")).alias("diagnostics"), kept(F.when(bare, F.col("stated")).otherwise(F.col("acted"))).alias("remediation"),
        F.when(F.col("refused").isNull(), notes_of((bare, "CORRECTION_USED"))).otherwise(F.array().cast(_TEXTS)).alias("notes"),
    )


def constructed_items(specs: DataFrame) -> DataFrame:
    """Constructed items from specs (package_id, item_id, kind, marks) and drafts (stem, answer, working, criteria, levels (label, descriptor, marks)).

    Levels without a label or descriptor, or below 0 marks, go. The ladder of allocation.rubric_ladder() takes the place of levels that are fewer than two
    or all of one mark (LADDER_FOR_NONE where the draft had none, else LADDER_FOR_EQUAL), or that award more than the item (LADDER_FOR_EXCESS). A numerical item without
    working is noted NO_WORKING. refused: NO_TEXT without a stem or an answer.
    """
    stem, answer, working = said(F.col("stem")), said(F.col("answer")), said(F.col("working"))
    whole = F.filter("levels", lambda v: said(v["label"]).isNotNull() & said(v["descriptor"]).isNotNull() & (v["marks"] >= 0))
    clean = F.coalesce(F.transform(whole, lambda v: F.struct(F.trim(v["label"]).alias("label"), F.trim(v["descriptor"]).alias("descriptor"), v["marks"].cast("int").alias("marks"))), F.array().cast("array<struct<label:string,descriptor:string,marks:int>>"))
    s = specs.select("package_id", "item_id", "kind", "marks", stem.alias("stem"), answer.alias("answer"), working.alias("working"), said(F.col("criteria")).alias("criteria"), clean.alias("clean"), (F.coalesce(F.size("levels"), F.lit(0)) > 0).alias("drafted"))
    awarded = F.transform("clean", lambda v: v["marks"])
    equal, excess = F.size(F.array_distinct(awarded)) < 2, F.coalesce(F.array_max(awarded) > F.col("marks"), F.lit(False))
    names = F.array(*[F.lit(n) for n in LEVELS])
    ladder = F.transform(rubric_ladder(F.col("marks")), lambda m, i: F.struct(F.get(names, i).alias("label"), F.when(i == 0, F.concat(F.lit("Gives in full: "), F.col("answer"))).otherwise(F.concat(F.lit("Gives "), m.cast("string"), F.lit(" marks' worth of: "), F.col("answer"))).alias("descriptor"), m.alias("marks")))
    refused = F.when(F.col("stem").isNull() | F.col("answer").isNull(), "NO_TEXT")
    kept = lambda c: F.when(refused.isNull(), c)
    notes = notes_of((equal & ~F.col("drafted"), "LADDER_FOR_NONE"), (equal & F.col("drafted"), "LADDER_FOR_EQUAL"), (~equal & excess, "LADDER_FOR_EXCESS"), ((F.col("kind") == "numerical") & F.col("working").isNull(), "NO_WORKING"))
    return s.select(
        "package_id", "item_id", "kind", "marks", refused.alias("refused"), kept(F.col("stem")).alias("stem"), kept(F.col("answer")).alias("answer"), kept(F.col("working")).alias("working"),
        kept(F.coalesce("criteria", F.concat(F.lit("How right and whole the answer is to: "), F.substring("stem", 1, 80)))).alias("criteria"), kept(F.when(equal | excess, ladder).otherwise(F.col("clean"))).alias("levels"),
        F.when(refused.isNull(), notes).otherwise(F.array().cast(_TEXTS)).alias("notes"),
    )
