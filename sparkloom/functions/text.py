"""Answer extraction, normalisation and scoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Number words, articles, marks and contractions of answer normalisation.
DIGITS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ["a", "an", "the"]
MARKS = [";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!"]
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've", "couldnt've": "couldn't've", "didnt": "didn't", "doesnt": "doesn't", "dont": "don't",
    "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't", "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll",
    "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've", "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's", "maam": "ma'am",
    "mightnt": "mightn't", "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't", "notve": "not've", "oclock": "o'clock",
    "oughtnt": "oughtn't", "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've",
    "shouldnt": "shouldn't", "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've", "somebodyll": "somebody'll",
    "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've", "someonell": "someone'll", "someones": "someone's", "somethingd": "something'd",
    "somethingd've": "something'd've", "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's", "thered": "there'd", "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're",
    "theres": "there's", "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've",
    "we'dve": "we'd've", "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd", "wheres": "where's",
    "whereve": "where've", "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's", "wont": "won't",
    "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll", "yall'd've": "y'all'd've",
    "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll", "youre": "you're", "youve": "you've",
}


def _null_if_none(text: Column, pattern: str) -> Column:
    """The pattern's first group, null where it isn't found."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def last_answer(text: Column) -> Column:
    """The last tagged answer, any case, trimmed; null without one."""
    return F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?is)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1)))


def first_answer(text: Column) -> Column:
    """The first tagged answer, as it is; null without one."""
    return _null_if_none(text, r"(?s)<answer>(.*?)</answer>")


def answer_or_text(text: Column) -> Column:
    return F.coalesce(F.nullif(first_answer(text), F.lit("")), F.trim(text))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalised(text: Column) -> Column:
    """Lower case, blanks squeezed, blanks and .,;:!? at the edges gone."""
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "), F.lit(" \t\r\n.,;:!?"))


def squad_normalised(text: Column) -> Column:
    """Lower case without punctuation and articles, blanks squeezed."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.array_join(F.filter(F.split(squeezed(bare), " "), lambda w: ~w.isin(ARTICLES)), " ")


def exact_match(text: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: squad_normalised(g) == squad_normalised(text)).cast("double")


def sub_match(text: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: F.contains(squad_normalised(text), squad_normalised(g))).cast("double")


def em_with_penalty(text: Column, golds: Column, score: float = 1.0) -> Column:
    """Exact match of the last answer, a quarter of the score where answer tags
    come more than ten times, 0 without an answer."""
    spam = (F.regexp_count(text, F.lit("<answer>")) > 10) | (F.regexp_count(text, F.lit("</answer>")) > 10)
    hit = exact_match(F.coalesce(last_answer(text), F.lit("")), golds) == 1
    return F.when(last_answer(text).isNull(), 0.0).when(hit, F.when(spam, score / 4).otherwise(score)).otherwise(0.0)


def option_match(gold: Column, text: Column) -> Column:
    """A gold of one Latin letter that the text, both normalised, starts with as a
    label."""
    g = normalised(gold)
    return g.rlike("^[a-z]$") & F.rlike(normalised(text), F.concat(F.lit("^"), F.when(g.rlike("^[a-z]$"), g).otherwise("a"), F.lit(r"(\b|[.)：:])")))


def rule_match(text: Column, gold: Column) -> Column:
    """Equal after normalisation, or a label that matches."""
    return (normalised(text) == normalised(gold)) | option_match(gold, text)


def gsm8k(text: Column, strict: bool = True) -> Column:
    """The number after ####, or the last number of a free text; a point alone is one only
    where there is no other."""
    if strict:
        return F.regexp_replace(_null_if_none(text, r"#### (\-?[0-9\.\,]+)"), r"[,$]", "")
    every = F.regexp_extract_all(text, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(F.filter(every, lambda x: x != "."), F.lit(-1)), F.get(every, 0))


def strict_format(text: Column) -> Column:
    """Exactly one pair of answer tags, any case, around something without tags,
    at the end of the final turn: the whole text, or what follows the last
    assistant mark where there are tool responses."""
    one = (F.regexp_count(text, F.lit("(?i)<answer>")) == 1) & (F.regexp_count(text, F.lit("(?i)</answer>")) == 1)
    final = F.when(text.rlike("(?i)<tool_response>"), F.regexp_extract(text, r"(?is)^.*(?:<\|im_start\|>|^|\s)assistant\s*(.*)$", 1)).otherwise(text)
    return one & final.rlike(r"(?is)<answer>\s*[^<>]+?\s*</answer>\s*$")


def mixed_reward(correct: Column, well_formed: Column, share: float = 0.1) -> Column:
    return (1 - share) * correct.cast("double") + share * well_formed.cast("double")


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_marks(text: Column) -> Column:
    """Marks gone, or a blank in their place: a mark goes if the text has it beside a
    blank, or has a comma between digits, else it becomes a blank.  Then the first 32
    points without a digit before or behind them go."""
    def bare(t, between):
        out = t
        for p in MARKS:
            beside = F.contains(t, F.lit(p + " ")) | F.contains(t, F.lit(" " + p))
            out = F.replace(out, F.lit(p), F.when(beside | between, "").otherwise(" "))
        return F.array_join(F.split(out, r"(?<![0-9])\.(?![0-9])", 33), "")

    # The text stands in every mark's rule: it and the comma's rule are computed once.
    return _once(text, lambda t: _once(t.rlike("[0-9],[0-9]"), lambda between: bare(t, between)))


def vqa_words(text: Column) -> Column:
    """Lower-case words without marks, number words as digits, no articles, contractions
    with their apostrophe."""
    digits, short = (F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) for table in (DIGITS, CONTRACTIONS))
    plain = without_marks(F.regexp_replace(F.regexp_replace(text, r"[\n\t]", " "), r"^\s+|\s+\z", ""))
    words = F.filter(F.split(F.lower(plain), r"\s+"), lambda w: w != "")
    kept = F.filter(F.transform(words, lambda w: F.coalesce(F.try_element_at(digits, w), w)), lambda w: ~w.isin(ARTICLES))
    return F.array_join(F.transform(kept, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def vqa_score(text: Column, golds: Column) -> Column:
    """Mean over the golds of min(1, matches among the others / 3)."""
    # A gold of its own counts for 1 where it matches; every text is put in normal form once.
    same = F.get(F.transform(F.array(vqa_words(text)), lambda said: F.transform(golds, lambda g: F.when(vqa_words(g) == said, 1).otherwise(0))), F.lit(0))

    def mean(hits):
        total = F.aggregate(hits, F.lit(0), lambda a, x: a + x)
        return F.aggregate(F.transform(hits, lambda h: F.least(F.lit(1.0), (total - h) / 3.0)), F.lit(0.0), lambda a, x: a + x) / F.size(hits)

    return F.get(F.transform(F.array(same), mean), F.lit(0))


def anls_distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer length, trimmed and lower case; 0 for two
    empty texts."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(x, y) / longest)


def anls(a: Column, b: Column, least: float = 0.5) -> Column:
    """1 - distance, 0 below ``least``."""
    s = 1 - anls_distance(a, b)
    return F.when(s >= least, s).otherwise(0.0)


def relaxed_accuracy(said: Column, gold: Column, tolerance: float = 0.05) -> Column:
    """Numbers within a relative tolerance (a percent sign divides by 100); a
    gold of 0 and texts go by case-insensitive equality."""

    def number(t):
        t = F.trim(t)
        return F.when(F.endswith(t, F.lit("%")), F.expr("1") * F.rtrim(t, F.lit("%")).try_cast("double") / 100).otherwise(t.try_cast("double"))

    a, b = number(said), number(gold)
    close = F.abs(a - b) / F.abs(b) <= tolerance
    return F.when(a.isNotNull() & b.isNotNull() & (b != 0), close).otherwise(F.lower(F.trim(said)) == F.lower(F.trim(gold)))


#: Phrases of a refusal, and of a failed call.
REFUSALS = ["Sorry, I can't help with images of people yet.", "I can't process this file.", "I'm sorry, but without the image provided", "Cannot determine the answer"]
FAILED = "Failed to obtain answer via API"


def infer_letter(text: Column, letters: str = "ABCDE", tail: int = 5) -> Column:
    """The only option letter among the words, if its first place is one of the
    last ``tail`` - 1; Z for a refusal, or a Z among words without a letter; else
    null, as for a failed call."""
    words = F.filter(F.split(F.regexp_replace(F.translate(text, ".()[],:;!*#{}", " " * 13), r"\s+", " "), " "), lambda w: w != "")
    seen = F.array_intersect(F.array(*[F.lit(c) for c in letters]), words)
    at = F.array_position(words, F.get(seen, 0)) - 1
    refused = F.exists(F.array(*[F.lit(x) for x in REFUSALS]), lambda x: F.contains(text, x))
    late = (F.size(seen) == 1) & (at > F.size(words) - tail)
    none = (F.size(seen) == 0) & F.array_contains(words, "Z")
    return F.when(F.contains(text, F.lit(FAILED)), F.lit(None)).when(refused | none, "Z").when(late, F.get(seen, 0))


def infer_order(text: Column) -> Column:
    """The order of four options: a word of four different letters A to D, else
    the letters after first, second, third and fourth, else after four steps."""
    up = F.upper(text)
    word = F.regexp_extract(up, r"\b([A-D]{4})\b", 1)
    # What names a place or a step.
    places = ["first|1st|首先|第一步", "second|2nd|其次|第二步", "third|3rd|再次|第三步", "fourth|4th|最后|第四步"]
    named = F.array_distinct(F.filter(F.array(*[F.upper(F.regexp_extract(up, f"(?i)(?:{x}).*?([A-D])", 1)) for x in places]), lambda x: x != ""))
    step = F.lit(r"(?i)(?:step\s*[\d一二三四]+|步骤\s*[\d一二三四]+|第\s*[\d一二三四]\s*步).*?([A-D])")
    steps = F.slice(F.regexp_extract_all(up, step, F.lit(1)), 1, 4)
    steps = F.array_distinct(F.transform(steps, F.upper))
    different = F.size(F.array_distinct(F.split(word, ""))) == 4
    return F.when((word != "") & different, word).when(F.size(named) == 4, F.array_join(named, "")).when(F.size(steps) == 4, F.array_join(steps, ""))


def boxed_equal(text: Column, gold: Column) -> Column:
    """1 where the last box holds the gold, letter for letter, else 0."""
    return F.coalesce((last_boxed(text) == gold).cast("double"), F.lit(0.0))


def think_box_format(text: Column) -> Column:
    """1 for a text of thoughts in tags and then a box, else 0."""
    return F.when(text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), 1.0).otherwise(0.0)


def strict_box(text: Column, gold: Column, tail: int = 100) -> Column:
    """1 where the last box within the last ``tail`` characters holds the gold as
    it is, else -1."""
    return F.when(last_boxed(F.right(text, F.lit(tail))) == gold, 1).otherwise(-1)


def anls_cut(a: Column, b: Column, cut: float = 0.5) -> Column:
    """1 - distance over the longer length, 0 where that is at most ``cut``."""
    s = 1 - anls_distance(a, b)
    return F.when(s > cut, s).otherwise(0.0)


def infer_by_text(text: Column, options: Column) -> Column:
    """The letter of the only option text that the answer contains, if the answer
    is at most twice as long as all options; ``options`` is a map."""
    total = F.aggregate(F.map_values(options), F.lit(0), lambda a, x: a + F.length(x))
    held = F.filter(F.map_entries(options), lambda e: F.contains(F.lower(text), F.lower(e["value"])))
    return F.when((F.length(text) <= 2 * total) & (F.size(held) == 1), held[0]["key"])


def yes_no(text: Column) -> Column:
    """yes or no, if the words, without marks, hold exactly one of them, else Unknown."""
    words = F.split(without_marks(F.lower(text)), r"\s+")
    y, n = F.array_contains(words, "yes"), F.array_contains(words, "no")
    return F.when(y & ~n, "Yes").when(n & ~y, "No").otherwise("Unknown")


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff]")


def half_width(text: Column) -> Column:
    """Full-width ASCII forms and blanks as plain ones."""
    wide = "".join(chr(0xFEE0 + c) for c in range(33, 127)) + "\u3000"
    return F.translate(text, wide, "".join(map(chr, range(33, 127))) + " ")


def hellaswag_clean(text: Column) -> Column:
    return F.replace(F.regexp_replace(F.replace(F.trim(text), F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def first_only(text: Column, old: str, new: str) -> Column:
    """The first occurrence of a fixed string replaced."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text)))).otherwise(text)


def question_normalised(text: Column) -> Column:
    """The first image tag dropped, blanks and tabs squeezed."""
    return F.trim(F.regexp_replace(first_only(text, "<image>", ""), "[ \\t]+", " "))


def passages(titles: str, texts: str) -> Column:
    return F.expr(f"array_join(transform(arrays_zip({titles}, {texts}), (p, i) -> concat('Doc ', i + 1, ' (Title: ', p.{titles}, ') ', p.{texts})), '\\n')")


@F.pandas_udf(T.StringType())
def last_boxed(texts):
    """What the last \\boxed{...} holds, braces matched; null without one."""

    def one(t):
        at = (t or "").rfind("\\boxed{")
        if at < 0:
            return None
        depth, start = 0, at + 7
        for i in range(start - 1, len(t)):
            depth += (t[i] == "{") - (t[i] == "}")
            if depth == 0:
                return t[start:i]
        return None

    return texts.map(one)


def math_normalised(text: Column) -> Column:
    """Spaces, dollar signs, degree marks, \\left and \\right, text wrappers and
    trailing dots gone, fractions in one spelling, thousands without commas."""
    t = F.trim(text)
    for pattern, by in ((r"\\(left|right|!|,|;)", ""), (r"\\(d|t)frac", r"\\frac"), (r"\\(text|mathrm|mbox)\{([^{}]*)\}", "$2"), (r"\^\{?\\circ\}?", ""), (r"\\?[$%]", ""), (r"(\d),(?=\d{3}(\D|$))", "$1"), (r"\\frac(\d)(\d)", r"\\frac{$1}{$2}"), (r"\s+", ""), (r"\.$", ""), (r"^0+(\d)", "$1"), (r"(\.\d*?)0+$", "$1"), (r"\.$", "")):
        t = F.regexp_replace(t, pattern, by)
    return t


def same_math(a: Column, b: Column) -> Column:
    x, y = math_normalised(a), math_normalised(b)
    return (x == y) | F.coalesce(x.try_cast("double") == y.try_cast("double"), F.lit(False))


#: Scorers by the source of a row; ``register_scorer`` adds more.
SCORERS = {}


def register_scorer(source: str):
    def add(fn):
        if SCORERS.get(source, fn) is not fn:
            raise ValueError(f"a scorer of {source} is registered already")
        SCORERS[source] = fn
        return fn

    return add


@register_scorer("math")
def _math(text, gold):
    return same_math(F.coalesce(last_answer(text), F.lit("")), gold).cast("double")


@register_scorer("qa")
def _qa(text, gold):
    return exact_match(F.coalesce(last_answer(text), F.lit("")), F.array(gold))


@register_scorer("gsm8k")
def _gsm8k(text, gold):
    return F.coalesce(gsm8k(text, False) == gold, F.lit(False)).cast("double")


def dispatched(source: Column, text: Column, gold: Column) -> Column:
    """Each row by its source's scorer; an unknown source is an error."""
    out = None
    for name, fn in SCORERS.items():
        out = F.when(source == name, fn(text, gold)) if out is None else out.when(source == name, fn(text, gold))
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for "), source)))
