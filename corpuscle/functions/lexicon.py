"""Predicates that read teaching texts by word lists, as column expressions.

All take normalised text (functions.text.simple_normalise or normalise) or its tokens, and stay in the
JVM. The word lists are fixed values of the rules: what a rule recognises. A vocabulary is a
package's own terms, an array column, so the same code serves any subject.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Levels from the lowest up, and the verbs that honestly denote them (fixed values).
BLOOM_ORDER = ("remember", "understand", "apply", "analyze", "evaluate", "create")
BLOOM_VERBS = {
    "remember": "state list name define recall identify label recognise recognize match locate quote reproduce".split(),
    "understand": "explain describe summarise summarize paraphrase illustrate classify outline restate convert estimate predict interpret".split(),
    "apply": "calculate compute solve apply use demonstrate construct measure determine derive plot draw carry perform execute implement adapt".split(),
    "analyze": "analyse analyze compare contrast differentiate distinguish examine infer trace attribute deconstruct investigate relate contextualise contextualize".split(),
    "evaluate": "evaluate justify critique judge assess argue defend recommend appraise weigh rank prioritise prioritize".split(),
    "create": "create design compose devise formulate produce plan propose generate reconstruct".split(),
}
#: Verbs of an objective that nobody can observe, and those that name an activity (fixed values).
VAGUE_VERBS = (
    "understand know learn appreciate grasp comprehend realise realize internalise internalize be become gain acquire "
    "familiarise familiarize study cover master value believe"
).split()
WEAK_VERBS = "explore discuss consider review revise look think engage work".split()
#: What a criterion may watch for (fixed values).
OBSERVABLE_VERBS = (
    "state states write writes say says list lists name names identify identifies label labels draw draws sort sorts match matches order orders "
    "calculate calculates solve solves explain explains describe describes predict predicts cite cites quote quotes argue argues justify justifies "
    "compare compares contrast contrasts present presents produce produces record records measure measures demonstrate demonstrates correct corrects "
    "complete completes annotate annotates rank ranks select selects point points read reads perform performs build builds hand hands answer answers "
    "use uses show shows give gives refer refers"
).split()
#: States of mind that nobody can watch (fixed values).
UNOBSERVABLE_MARKERS = (
    "understand", "understands", "understanding", "know", "knows", "knowledge of", "appreciate", "appreciates", "aware", "awareness", "grasp", "grasps",
    "realise", "realize", "enjoy", "enjoys", "feel", "feels", "believe", "believes", "internalise", "internalize", "familiar", "learn", "learns", "learnt", "learned",
)
#: Advice that fits any class (fixed values).
GENERIC_DIFFERENTIATION = (
    "extra help", "more help", "additional help", "additional support", "extra support", "more support", "weaker students", "weak students", "struggling students",
    "slower learners", "slow learners", "less able", "fast finishers", "early finishers", "advanced students", "able students", "gifted students", "bright students",
    "more challenging", "harder questions", "harder problems", "extra questions", "extra problems", "more questions", "more problems", "more practice",
    "further practice", "additional practice", "extra work", "more work", "as needed", "if necessary", "if required", "where appropriate", "as required",
    "give more time", "allow more time", "provide guidance", "offer guidance", "simplify the task", "make it easier", "make it harder", "help them", "support them", "challenge them",
)
#: More work rather than different work (fixed values).
VOLUME_ONLY = (
    "more questions", "more problems", "more practice", "extra questions", "extra problems", "additional questions", "additional problems", "more examples", "further examples", "same task",
    "more of the same",
)
#: Descriptors that grade without describing (fixed values).
HEDGES = (
    "good answer", "excellent answer", "adequate answer", "poor answer", "very good", "fairly good", "some understanding", "little understanding", "no understanding",
    "partially correct", "mostly correct", "as expected", "satisfactory", "unsatisfactory", "appropriate response",
)
#: Options that fill a line (fixed values).
FILLER_OPTIONS = ("all of the above", "none of the above", "both a and b", "all of these")
#: Sentences about teaching rather than instructions to teach (fixed values).
GENERIC_SCRIPT = (
    "engage the students", "engage students", "engage the class", "in a meaningful way", "meaningful way", "following along", "ensure that everyone", "ensure everyone",
    "ensure all students", "make sure everyone", "make sure all students", "go over the material", "go through the material", "cover the material", "discuss the topic",
    "discuss the concept", "talk about the topic", "explain the topic", "explain the concept clearly", "as needed", "if time permits", "if time allows", "as appropriate",
    "where appropriate", "keep the students engaged", "maintain student interest", "encourage participation", "encourage students to participate", "facilitate discussion",
    "facilitate a discussion", "guide the students", "guide students through", "help students understand", "check for understanding", "build on prior knowledge",
    "activate prior knowledge", "take a moment", "spend some time",
)
#: Equipment that an ordinary classroom lacks (fixed values).
EXOTIC_MATERIALS = (
    "oscilloscope", "spectrophotometer", "centrifuge", "3d printer", "vr headset", "virtual reality", "arduino", "raspberry pi", "microcontroller", "laser cutter", "smart board", "smartboard",
    "interactive whiteboard", "one laptop per student", "laptop per student", "tablet per student", "one tablet per", "class set of laptops", "class set of tablets", "drone", "photogate",
    "data logger", "motion sensor", "force sensor", "wind tunnel", "kiln", "telescope", "microscope slide kit", "liquid nitrogen", "bunsen burner per student",
)
#: Words of a title that name a place in a book (fixed values).
PLACES_IN_BOOKS = (
    "chapter unit lesson section module part book volume page topic exercise introduction revision appendix syllabus curriculum textbook chapters units lessons"
).split()
#: Verbs that open an instruction to a teacher (fixed values).
IMPERATIVES = (
    "ask tell say state write draw sketch label annotate underline circle highlight show display project point read recap review summarise summarize introduce explain "
    "define derive model demonstrate run start begin open close end pause stop wait time collect hand distribute give return circulate monitor listen watch check elicit "
    "prompt pose invite call nominate pair group split arrange seat set assign remind emphasise emphasize stress repeat connect link refer compare contrast work solve "
    "calculate count measure place hold drop push pull pass put take bring use play record mark correct collectively note list name clarify rephrase unpack walk build "
    "construct test try predict sample select choose cover reveal hide reset sort gather tally issue swap rank order number tick trace scan board post pin"
).split()
#: Closed-class words, and words that grade without naming anything (fixed values).
FUNCTION_WORDS = (
    "a an the this that these those and or but nor so if then than as because while when where which who whom whose what why how is are was were be been being am do does "
    "did done have has had having can could will would shall should may might must of in on at to for with without from by about into onto over under up down out off "
    "through between against during before after above below again further here there all any both each few more most other some such no not only own same very just also "
    "it its they them their he she his her him we us our you your i me my one two three e g eg ie etc yet still well much many every either neither per via upon within"
).split()
EVALUATIVE_MARKERS = (
    "excellent outstanding exemplary strong good sound solid adequate satisfactory acceptable fair average reasonable limited weak poor minimal basic partial partially "
    "incomplete complete completely full fully thorough thoroughly detailed clear clearly accurate accurately correct correctly incorrect wrong some little no none mostly "
    "largely generally sometimes always never response answer work student students attempt attempts level quality shows show demonstrates demonstrate displays display "
    "exhibits provides gives includes contains understanding knowledge awareness grasp appreciation overall throughout well better best worse worst"
).split()
LEAST_TERM, LEAST_CONTENT, LEAST_WORDS = 4, 3, 6
QUANTITY = "\\d+\\s*(?:[a-zA-Z°%/]+|$)|[a-zA-Z]\\s*=\\s*\\S"
FRAME = "['\"][^'\"]{12,}['\"]|\\bsentence (?:frame|starter|stem)\\b|\\bword bank\\b|\\btemplate\\b"
PADDING = "(?i)^\\s*(?:(?:the\\s+)?(?:students?|learners?|pupils?|candidates?)\\s+(?:will|should|can|must)\\s+)?(?:be\\s+able\\s+to\\s+)?"
ARTICLE = "^(?:the|a|an|its|his|her|their)\\s+"


def words(ws) -> Column:
    """A fixed list, as one literal: a plan with a node for each word of each list fills the driver."""
    return F.split(F.lit("\n".join(ws)), "\n") if ws else F.array().cast("array<string>")


def any_phrase(normalised: Column, phrases) -> Column:
    """One of the phrases stands anywhere in the text."""
    return T.let(normalised, lambda s: F.exists(words(phrases), lambda p: F.contains(s, p)))


def leading_verb(tokens: Column) -> Column:
    """The first token; empty without one."""
    return F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))


def bloom_of(verb: Column) -> Column:
    """The level that a verb denotes, null for an unknown one."""
    out = F.lit(None).cast("string")
    for level, verbs in BLOOM_VERBS.items():
        out = F.when(verb.isin(*verbs), F.lit(level)).otherwise(out)
    return out


def bloom_index(level: Column) -> Column:
    """Position on the ladder from 0, -1 for anything else."""
    return (F.coalesce(F.array_position(words(BLOOM_ORDER), level), F.lit(0)) - 1).cast("int")


def bloom_distance(declared: Column, implied: Column) -> Column:
    """Rungs between two levels; 0 if one is unknown."""
    at = F.struct(bloom_index(declared).alias("a"), bloom_index(implied).alias("b"))
    return T.let(at, lambda x: F.when((x["a"] < 0) | (x["b"] < 0), 0).otherwise(F.abs(x["a"] - x["b"])))


def capped_bloom(level: Column, ceiling: str = "apply") -> Column:
    """A level cut to the ceiling (a multiple-choice item's, as a rule); unknown ones count as understand."""
    at = bloom_index(level)
    return F.when(at < 0, "understand").when(at > BLOOM_ORDER.index(ceiling), ceiling).otherwise(level)


def vocabulary_terms(normalised: Column) -> Column:
    """What one name adds to a vocabulary: the phrase of its words, if it has LEAST_TERM characters, and its words of as many."""
    return T.let(T.word_tokens(normalised), lambda found: F.array_distinct(F.filter(F.concat(F.array(F.array_join(found, " ")), found), lambda t: F.length(t) >= LEAST_TERM)))


def mentions_vocabulary(tokens: Column, vocabulary: Column) -> Column:
    """A term of the vocabulary stands among the tokens; a term of several words, anywhere in them joined by blanks."""
    x = F.struct(tokens.alias("k"), vocabulary.alias("v"), F.array_join(tokens, " ").alias("joined"))
    named = lambda x: F.exists(x["v"], lambda t: F.when(F.contains(t, F.lit(" ")), F.contains(x["joined"], t)).otherwise(F.array_contains(x["k"], t)))
    return T.let(x, lambda x: (F.size(x["k"]) > 0) & named(x))


def has_concrete_anchor(raw: Column, tokens: Column, vocabulary: Column) -> Column:
    """Names the vocabulary, a quantity with a unit or symbol, or a literal to hand over; the latter two are read from the raw text."""
    return mentions_vocabulary(tokens, vocabulary) | has_literal_anchor(raw)


def has_literal_anchor(raw: Column) -> Column:
    """A quantity with a unit or symbol, or a literal to hand over."""
    return raw.rlike(QUANTITY) | raw.rlike(FRAME)


def _names_something(token: Column) -> Column:
    """Of three letters or more, no function or grading word, no number. The words are a set of literals, which Spark looks up by hash."""
    noise = sorted({*FUNCTION_WORDS, *EVALUATIVE_MARKERS, *(m for m in UNOBSERVABLE_MARKERS if " " not in m)})
    return (F.length(token) >= LEAST_CONTENT) & ~token.isin(*noise) & ~token.rlike("^[0-9]+$")


def content_words(tokens: Column) -> Column:
    """The different words that name something: of three letters or more, no function or grading word, no number, without a last s."""
    kept = F.filter(tokens, _names_something)
    return F.array_distinct(F.transform(kept, lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.coalesce(F.nullif(F.regexp_replace(t, "(?:'s|s)$", ""), F.lit("")), t)).otherwise(t)))


def has_content(tokens: Column) -> Column:
    """There is a content word; the first one settles it."""
    return F.exists(tokens, _names_something)


def descriptor_discrimination(contents: Column) -> Column:
    """How well levels tell apart, from their content words in order: the mean of the share that names something and the share of neighbours that differ; 0 below two levels."""
    differ = lambda a, b: (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)

    def told(c: Column) -> Column:
        n = F.size(c)
        named = F.size(F.filter(c, lambda x: F.size(x) > 0)) / n
        pairs = F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: differ(F.get(c, i - 1), F.get(c, i))))
        return F.when(n < 2, 0.0).otherwise((named + pairs / (n - 1)) / 2)

    return T.let(contents, told)


def has_imperative(normalised: Column) -> Column:
    """A sentence opens with an instruction to the teacher."""
    verbs = words(IMPERATIVES)
    firsts = F.transform(T.sentences(normalised), lambda s: leading_verb(T.word_tokens(s)))
    return F.exists(firsts, lambda v: F.array_contains(verbs, v))


def is_generic_script(normalised: Column) -> Column:
    return any_phrase(normalised, GENERIC_SCRIPT)


def note_is_actionable(normalised: Column, tokens_with_context: Column, vocabulary: Column) -> Column:
    """Instructs, is no generic prose, and names the package's content, in the note or its context."""
    return actionable(is_generic_script(normalised), has_imperative(normalised), mentions_vocabulary(tokens_with_context, vocabulary))


def actionable(generic: Column, imperative: Column, named: Column) -> Column:
    """note_is_actionable() from what it asks, for whoever needs those answers, too."""
    return ~generic & imperative & named


def criterion_is_observable(normalised: Column, tokens: Column) -> Column:
    """1 if a criterion names something to watch, 0 if only a state of mind, null if the lists cannot tell."""
    seen = lambda k: F.arrays_overlap(k, words(OBSERVABLE_VERBS))
    mind = lambda k: F.arrays_overlap(k, words([m for m in UNOBSERVABLE_MARKERS if " " not in m])) | any_phrase(normalised, [m for m in UNOBSERVABLE_MARKERS if " " in m])
    return T.let(tokens, lambda k: F.when(seen(k), 1.0).when(mind(k), 0.0))


def specificity(raw: Column, normalised: Column, tokens: Column, vocabulary: Column) -> Column:
    """How usable an instruction is, 0 to 1: short ones lose 0.4, generic ones 0.5 (0.15 if anchored), unanchored ones 0.25."""
    generic, anchored = any_phrase(normalised, GENERIC_DIFFERENTIATION), has_concrete_anchor(raw, tokens, vocabulary)
    return specificity_of(F.size(tokens), generic, anchored)


def specificity_of(n: Column, generic: Column, anchored: Column) -> Column:
    """specificity() from the number of tokens and the two answers."""
    x = F.struct(n.alias("n"), generic.alias("generic"), anchored.alias("anchored"))
    lost = lambda x: F.when(x["n"] < LEAST_WORDS, 0.4).otherwise(0.0) + F.when(x["generic"] & ~x["anchored"], 0.5).when(x["generic"], 0.15).otherwise(0.0) + F.when(~x["anchored"], 0.25).otherwise(0.0)
    return T.let(x, lambda x: F.greatest(F.lit(0.0), 1.0 - lost(x)))


def unpadded(statement: Column) -> Column:
    """A statement without "students will be able to"."""
    return F.regexp_replace(statement, PADDING, "")


def effective_verb(normalised: Column) -> Column:
    """The verb that governs an objective, behind any padding; empty without one."""
    return leading_verb(T.word_tokens(unpadded(normalised)))


def is_padded(normalised: Column) -> Column:
    return F.array_join(T.word_tokens(unpadded(normalised)), " ") != F.array_join(T.word_tokens(normalised), " ")


def restates_a_concept(normalised: Column, concepts: Column, threshold: float = 0.85) -> Column:
    """A verb and a concept's name and nothing more. concepts: the token lists of the names."""
    return T.let(T.word_tokens(unpadded(normalised)), lambda rest: tokens_restate_a_concept(rest, concepts, threshold))


def tokens_restate_a_concept(rest: Column, concepts: Column, threshold: float = 0.85) -> Column:
    """restates_a_concept() from the tokens of an unpadded statement."""
    after = lambda rest: F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0)))
    tail = lambda rest: F.array_distinct(T.word_tokens(F.regexp_replace(F.array_join(after(rest), " "), ARTICLE, "")))
    # A set is no more alike to a list of fewer words than that list is long for it, so most names need no comparison.
    alike = lambda t: F.exists(concepts, lambda c: (F.size(c) > 0) & (F.try_divide(F.size(c).cast("double"), F.size(t)) >= threshold) & (T.jaccard(t, F.array_distinct(c)) >= threshold))
    return (F.size(rest) < 2) | T.let(tail(rest), alike)


def as_label(raw: Column, most: int = 6) -> Column:
    """A name for a time slot: the first clause (up to : ; - or a dash), six words at most, without marks at its end."""
    out = F.array_join(T.blank_tokens(raw), " ")
    cut = F.lit(None).cast("string")
    for mark in reversed((":", ";", " - ", " — ")):
        head = F.trim(F.substring_index(out, mark, 1))
        cut = F.when(F.contains(out, F.lit(mark)) & (head != ""), head).otherwise(cut)
    return F.trim(F.regexp_replace(F.array_join(F.slice(T.blank_tokens(F.coalesce(cut, out)), 1, most), " "), "[ ,.;:\\-—]+$", ""))


#: Signs and their LaTeX names (fixed values).
LATEX = {
    "α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "δ": "\\delta", "θ": "\\theta", "λ": "\\lambda", "μ": "\\mu", "π": "\\pi", "σ": "\\sigma", "ω": "\\omega", "Δ": "\\Delta", "Ω": "\\Omega",
    "×": "\\times", "÷": "\\div", "±": "\\pm", "≠": "\\neq", "≈": "\\approx", "≤": "\\leq", "≥": "\\geq", "√": "\\sqrt", "∑": "\\sum", "∏": "\\prod", "∫": "\\int", "∞": "\\infty",
    "∂": "\\partial", "∇": "\\nabla", "→": "\\to", "⇒": "\\Rightarrow",
}


def to_latex(line: Column) -> Column:
    """LaTeX for an equation line: signs by name, raised and lowered digits as scripts; what is LaTeX already stays; null for other lines."""
    s = F.trim(line)
    out = s
    for sign, name in LATEX.items():
        out = F.replace(out, F.lit(sign), F.lit(f" {name} "))
    for digits, mark in (("⁰¹²³⁴⁵⁶⁷⁸⁹", "^"), ("₀₁₂₃₄₅₆₇₈₉", "_")):
        out = F.translate(F.regexp_replace(out, f"([{digits}]+)", f"{mark}{{$1}}"), digits, "0123456789")
    out = F.nullif(F.trim(F.regexp_replace(out, "\\s{2,}", " ")), F.lit(""))
    return F.when(s == "", None).when(s.startswith("$") & s.endswith("$"), F.trim(F.btrim(s, F.lit("$")))).when(F.contains(s, F.lit("\\")), s).when(T.is_equation(s), out)


def has_devanagari(text: Column) -> Column:
    return text.rlike("[\\u0900-\\u097F]")


def strip_fences(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), "(?s)^```[a-zA-Z]*\\s*\\n?(.*?)\\s*```$", "$1"))


def extract_json(text: Column) -> Column:
    """What stands between the first opening and the last closing brace of an answer; null without them."""
    return F.nullif(F.regexp_extract(strip_fences(text), "(?s)\\{.*\\}", 0), F.lit(""))


def escaped_block(text: Column, tag: str = "document") -> Column:
    """A document as a quoted block of a prompt: its own closing tags can't end the block."""
    safe = F.regexp_replace(text, f"(?i)</({tag})", "&lt;/$1")
    return F.concat(F.lit(f"<{tag}>\n"), safe, F.lit(f"\n</{tag}>"))


def first_filled(*values: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def sample_id(name: Column, namespace: bytes = bytes.fromhex("6ba7b8119dad11d180b400c04fd430c8")) -> Column:
    """The version 5 UUID of a name, by default in the namespace of URLs."""
    h = F.sha1(F.concat(F.lit(namespace), name.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def last_numbers(message: Column, keys: tuple[str, ...] = ("limit", "used", "requested")) -> list[Column]:
    """The numbers that a message names by key ("Limit 8000, Used: 7,900"), whatever their order; of a key named twice the last counts, a missing one is null."""
    out = []
    for key in keys:
        found = F.regexp_extract_all(F.lower(message), F.lit(f"{key}\\W{{0,3}}([0-9][0-9,]*)"), 1)
        out.append(F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit("")).try_cast("long").alias(key))
    return out


def retry_seconds(header: Column, message: Column) -> Column:
    """Seconds to wait: the header's number, else minutes and seconds in the message ("2m7.5s"), else null."""
    part = lambda p: F.nullif(F.regexp_extract(message, p, 1), F.lit("")).try_cast("double")
    minutes, seconds = part("([0-9.]+)m(?![a-z])"), part("([0-9.]+)s(?![a-z])")
    minutes = F.coalesce(minutes, part("([0-9.]+)m[0-9]"))
    said = F.when(minutes.isNotNull() | seconds.isNotNull(), F.coalesce(minutes, F.lit(0.0)) * 60 + F.coalesce(seconds, F.lit(0.0)))
    return F.coalesce(header.try_cast("double"), said)
