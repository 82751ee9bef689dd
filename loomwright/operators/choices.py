"""Multiple-choice items: validity, rendering, wrapping, few-shot examples, subjects, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import arrays as R
from loomwright.functions import text as T
from loomwright.functions.text import let
from loomwright.operators.splits import hash_order

#: Options whose meaning depends on their place.
ORDER_DEPENDENT = ["ඉහත සියල්ල", "ඉහත සඳහන් සියල්ල", "ඉහත කිසිවක්", "කිසිවක් නොවේ", "A සහ B", "I සහ II"]
#: Category tokens at the ends of file names.
KNOWN_CATEGORIES = ["social science", "social_science", "business studies", "business_studies", "humanities", "language", "stem", "other"]

#: The subcategory of each subject, and the subcategories of each domain.
SUBJECT_SUBCATEGORIES = {
    "abstract_algebra": "math",
    "anatomy": "health",
    "astronomy": "physics",
    "business_ethics": "business",
    "clinical_knowledge": "health",
    "college_biology": "biology",
    "college_chemistry": "chemistry",
    "college_computer_science": "computer science",
    "college_mathematics": "math",
    "college_medicine": "health",
    "college_physics": "physics",
    "computer_security": "computer science",
    "conceptual_physics": "physics",
    "econometrics": "economics",
    "electrical_engineering": "engineering",
    "elementary_mathematics": "math",
    "formal_logic": "philosophy",
    "global_facts": "other",
    "high_school_biology": "biology",
    "high_school_chemistry": "chemistry",
    "high_school_computer_science": "computer science",
    "high_school_european_history": "history",
    "high_school_geography": "geography",
    "high_school_government_and_politics": "politics",
    "high_school_macroeconomics": "economics",
    "high_school_mathematics": "math",
    "high_school_microeconomics": "economics",
    "high_school_physics": "physics",
    "high_school_psychology": "psychology",
    "high_school_statistics": "math",
    "high_school_us_history": "history",
    "high_school_world_history": "history",
    "human_aging": "health",
    "human_sexuality": "culture",
    "international_law": "law",
    "jurisprudence": "law",
    "logical_fallacies": "philosophy",
    "machine_learning": "computer science",
    "management": "business",
    "marketing": "business",
    "medical_genetics": "health",
    "miscellaneous": "other",
    "moral_disputes": "philosophy",
    "moral_scenarios": "philosophy",
    "nutrition": "health",
    "philosophy": "philosophy",
    "prehistory": "history",
    "professional_accounting": "other",
    "professional_law": "law",
    "professional_medicine": "health",
    "professional_psychology": "psychology",
    "public_relations": "politics",
    "security_studies": "politics",
    "sociology": "culture",
    "us_foreign_policy": "politics",
    "virology": "health",
    "world_religions": "philosophy",
}
DOMAIN_SUBCATEGORIES = {
    "stem": ["physics", "chemistry", "biology", "computer science", "math", "engineering"],
    "humanities": ["history", "philosophy", "law"],
    "social_sciences": ["politics", "culture", "economics", "geography", "psychology"],
    "other": ["other", "business", "health"],
}
LETTERS = "ABCDEFGHIJ"


def subject_domains() -> dict[str, str]:
    of = {s: d for d, own in DOMAIN_SUBCATEGORIES.items() for s in own}
    return {x: of[s] for x, s in SUBJECT_SUBCATEGORIES.items()}


def domain(subject: Column) -> Column:
    pairs = [F.lit(x) for k, v in sorted(subject_domains().items()) for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), subject), F.lit("other"))


def valid_index(answer: Column, choices: Column, base: int = 0, least: int = 2, exactly: int | None = None) -> Column:
    n = F.size(choices)
    size = n == exactly if exactly else n >= least
    return F.coalesce(size & (answer >= base) & (answer < n + base), F.lit(False))


def valid_label(label: Column, choices: Column) -> Column:
    """A label written in digits that is an option."""
    x = T.strip(T.empty_if_null(label))
    return F.coalesce(x.rlike(r"^[0-9]+\z") & (x.try_cast("int") < F.size(choices)) & (F.size(choices) >= 2), F.lit(False))


def malformed(question: Column, choices: Column, answer: Column) -> Column:
    return ~valid_index(answer, choices, exactly=4)


def has_empty_field(question: Column, choices: Column) -> Column:
    return (T.collapse_ws(question) == "") | F.exists(choices, lambda c: T.collapse_ws(c) == "")


def collapsed(choices: Column, n: int = 4) -> Column:
    return F.size(F.array_distinct(F.transform(choices, T.collapse_ws))) < n


def order_dependent(choices: Column, phrases: list[str] = ORDER_DEPENDENT) -> Column:
    return F.exists(choices, lambda c: F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(c, p)))


def option_list(choices: Column, letters: bool = False) -> Column:
    mark = (lambda i: F.substring(F.lit(LETTERS), i + 1, F.lit(1))) if letters else (lambda i: (i + 1).cast("string"))
    return F.array_join(F.transform(choices, lambda c, i: F.concat(mark(i), F.lit(". "), T.collapse_ws(c))), "\n")


def number_list(choices: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.size(choices)), lambda i: i.cast("string")), ", ")


def render(template: str, subject: Column, question: Column, choices: Column, answer: Column | None = None, letters: bool = False, fallback: str = "", gap: str = " ") -> Column:
    """The template's marks are replaced in order; an item without answer ends with the gap, so that the
    answer is the next token."""
    out = F.replace(F.lit(template), F.lit("[SUBJECT]"), F.coalesce(F.nullif(T.collapse_ws(subject), F.lit("")), F.lit(fallback)))
    out = F.replace(out, F.lit("[NUMS]"), number_list(choices))
    out = F.replace(out, F.lit("[QUESTION]"), T.collapse_ws(question))
    out = F.replace(out, F.lit("[OPTIONS]"), option_list(choices, letters))
    return F.concat(out, F.lit(gap) if answer is None else F.concat(F.lit(" "), answer.cast("string")))


def template_of(text: str) -> str:
    """A template file's text with its first list of four numbers made a mark."""
    import re

    return re.sub(r"1\s*,\s*2\s*,\s*3\s*,\s*4", "[NUMS]", text.strip("\n"), count=1)


#: Wrappers of instruction-tuned models.
ALPACA = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n### Instruction:\n{}\n\n### Input:\n{}\n\n### Response:\n{}"
CHAT = "### User:\n{}\n\n{}\n\n### Assistant:\n{}"
CHAT_END = "<|end_of_text|>"


def wrap_blocks(prompt: Column, form: str, cue: str, marker: str = "\n", end: str = "") -> Column:
    """Each block of a prompt (blank lines between) as instruction, input and response: the response begins at
    the last cue, the input behind the first marker.  All blocks but the last get the end."""
    pieces = form.split("{}")

    def block(b: Column) -> Column:
        has = F.contains(b, F.lit(cue))
        after = F.when(has, F.substring_index(b, cue, -1)).otherwise(b)
        before = F.when(has, F.substr(b, F.lit(1), F.length(b) - F.length(after) - len(cue))).otherwise("")
        instruction = F.substring_index(before, marker, 1)
        rest = F.substr(before, F.length(instruction) + len(marker) + 1)
        body = F.concat(F.lit(marker.lstrip("\n")), rest)
        response = F.concat(F.when(has, cue).otherwise(""), after)
        return F.concat(F.lit(pieces[0]), T.strip(instruction), F.lit(pieces[1]), T.strip(body), F.lit(pieces[2]), response, F.lit(pieces[3]))

    def all_(bs: Column) -> Column:
        last = F.size(bs) - 1
        return F.array_join(F.transform(bs, lambda b, i: F.concat(block(b), F.when(i < last, end).otherwise(""))), "\n\n")

    return let(F.split(prompt, "\n\n"), all_)


def few_shot_prefix(shots: DataFrame, keys: list[str], order: str, block: str, k: int) -> DataFrame:
    """keys, prefix: the first k rendered blocks of each group (k is small), blank lines between."""
    first = shots.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("__r") <= k)
    rows = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", block))).alias("x"))
    return rows.select(*keys, F.array_join(F.transform("x", lambda s: s[block]), "\n\n").alias("prefix"))


def with_prefix(items: DataFrame, prefixes: DataFrame, keys: list[str], block: str) -> DataFrame:
    rows = items.join(prefixes, keys, "left")
    return rows.withColumn("prompt", F.when(F.col("prefix").isNull(), F.col(block)).otherwise(F.concat("prefix", F.lit("\n\n"), block)))


def match_subjects(items: DataFrame, shots: DataFrame, level: str, key: str) -> DataFrame:
    """level, key and the key of the examples to take: the same, else the longest (of ties the last) that
    contains it or is contained in it; null if there is none.  Both sides are the distinct subjects of an
    evaluation, tens of rows."""
    want, have = items.select(level, key).distinct(), shots.select(level, F.col(key).alias("shot_key")).distinct()
    pairs = want.join(have, level, "left").where(F.col("shot_key").isNull() | F.contains(key, F.col("shot_key")) | F.contains("shot_key", F.col(key)))
    best = F.max_by("shot_key", F.struct((F.col("shot_key") == F.col(key)).alias("same"), F.length("shot_key").alias("n"), "shot_key"))
    return want.join(pairs.where("shot_key <> ''").groupBy(level, key).agg(best.alias("shot_key")), [level, key], "left")


def balanced_examples(df: DataFrame, gold: str, order: str, per_key: int, seed: str) -> DataFrame:
    """The rows chosen as examples: per_key for each answer, in hash order."""
    w = Window.partitionBy(gold).orderBy(hash_order(seed, order), order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_key).drop("__r")


def shuffle_options(choices: Column, answer: Column, seed: Column) -> Column:
    """struct(choices, answer): options in hash order, the answer's index following; options whose meaning
    depends on their place stay."""

    def body(c: Column) -> Column:
        keyed = F.array_sort(F.transform(c, lambda x, i: F.struct(F.md5(F.concat_ws("|", seed, i.cast("string"), x)).alias("h"), i.alias("i"), x.alias("x"))))
        mixed = F.struct(F.transform(keyed, lambda k: k["x"]).alias("choices"), (F.array_position(F.transform(keyed, lambda k: k["i"]), answer.cast("int")) - 1).cast("int").alias("answer"))
        return F.when(order_dependent(c), F.struct(c.alias("choices"), answer.cast("int").alias("answer"))).otherwise(mixed)

    return let(choices, body)


def rotations(items: DataFrame, choices: str) -> DataFrame:
    """A row for each rotation of an item's options, with rot and rotated."""
    return items.select("*", F.explode(F.sequence(F.lit(0), F.size(choices) - 1)).alias("rot")).withColumn("rotated", R.rotate(F.col(choices), F.col("rot")))


def option_text(choices: Column, index: Column) -> Column:
    """The option at an index; null outside."""
    return F.get(choices, index)


def route(model: Column) -> Column:
    """The prompt format that a model's name calls for.  Fixed values: the parts of names and the formats."""
    name = F.lower(model)
    return F.when(F.contains(name, F.lit("bactrian")), "alpaca").when(F.contains(name, F.lit("chat")) | F.contains(name, F.lit("uc")), "chat").otherwise("raw")


def subject_of_file(name: Column) -> Column:
    """struct(key, display) from a file name: ending, suffixes, difficulty and one category token go."""
    base = F.regexp_replace(F.substring_index(name, "/", -1), r"(?i)\.json\z", "")
    for p in (r"(?i)_fewshot\z", r"(?i)_f_\d+[a-z]?\z", r"(?i)_(easy|medium|hard)\z"):
        base = F.regexp_replace(base, p, "")
    known = "|".join(sorted(KNOWN_CATEGORIES, key=len, reverse=True))
    base = F.regexp_replace(base, rf"(?i)(?<=.)[_ ](?:{known})\z", "")
    display = T.strip(F.replace(base, F.lit("_"), F.lit(" ")))
    return F.struct(T.letters_key(display).alias("key"), display.alias("display"))


def canonical_names(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """key and the display name with most capitals, then the longest, then the first."""
    rank = F.struct(F.regexp_count(name, F.lit(r"\p{Lu}")).alias("a"), F.length(name).alias("b"), -F.col(order))
    return rows.groupBy(key).agg(F.max_by(name, rank).alias("label"))


def calibrated(scores: DataFrame, priors: DataFrame, keys: list[str], score: str = "scores", prior: str = "prior") -> DataFrame:
    """pred: the best option after the group's prior scores are taken off."""
    rows = scores.join(priors, keys, "left")
    return rows.withColumn("pred", R.argmax(F.when(F.col(prior).isNull(), F.col(score)).otherwise(R.minus(F.col(score), F.col(prior)))).cast("int")).drop(prior)
