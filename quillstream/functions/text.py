"""Text expressions with the character classes of Unicode, whatever the engine's defaults.

Every function takes and returns columns, so that projections stay inside generated code. A null text counts as an
empty one unless stated otherwise.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, written so that Java's regular expressions and RE2 read them alike.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SP = f"[{SPACE}]"
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LETTER = r"\p{L}"
ALNUM = r"\p{L}\p{N}"
WORD = r"[\p{L}\p{N}_]"
PLAIN_WORD = r"[A-Za-z\x{391}-\x{3a9}\x{3b1}-\x{3c9}\x{386}-\x{38f}\x{3ac}-\x{3ce}\x{3ca}\x{3cb}\x{390}\x{3b0}]{2,}"
BAD_ACCENT = r"[\x{391}-\x{3a9}\x{3b1}-\x{3c9}\x{3ac}\x{3ad}\x{3ae}\x{3af}\x{3cc}\x{3cd}\x{3ce}\x{3ca}\x{3cb}\x{390}\x{3b0}][\x{300}-\x{36f}]"
SIGNATURE = r"(?is)Ministry of Digitally.*?Location:\s*Athens"
NUMBER = r"\p{Nd}+(?:[.,/\-]\p{Nd}+)*"
# Thresholds of the quality profile, and the reasons in the order they are given.
MIN_LENGTH, MIN_LETTERS, MIN_WORDS, MAX_ACCENTS, MAX_SYMBOLS = 100, 0.55, 20, 10, 0.25
#: Days from 1970 that the engine's dates hold.
FAR_DAYS = 2**31 - 1
REASONS = ["very_short_text", "low_letter_ratio", "very_few_words", "many_corrupted_accents", "high_symbol_ratio"]


def filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def truthy(c: Column) -> Column:
    """The value, or null where it is an empty string; blanks count as a value."""
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def joined_hyphens(c: Column) -> Column:
    """Words broken at a hyphen before a line end, joined; the quick test spares texts without one the search from every letter."""
    return F.when(c.rlike(f"-{SP}*\\n"), F.regexp_replace(c, f"({WORD})-{SP}*\\n{SP}*({WORD})", "$1$2")).otherwise(c)


def line_ends(c: Column) -> Column:
    """Line ends as \\n, each by a plain search."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def few_empty_lines(c: Column) -> Column:
    return F.when(c.contains("\n\n\n"), F.regexp_replace(c, "\\n{3,}", "\n\n")).otherwise(c)


def _tidy(c: Column) -> Column:
    c = F.regexp_replace(joined_hyphens(c), "[ \\t]*\\n[ \\t]*", "\n")
    return strip(few_empty_lines(F.regexp_replace(c, "\\t[ \\t]*| [ \\t]+", " ")))


def clean_external(c: Column) -> Column:
    """Line ends, hyphenated breaks, runs of blanks and of empty lines."""
    return _tidy(line_ends(F.replace(filled(c), F.lit("\x00"), F.lit(" "))))


def clean_page(c: Column) -> Column:
    """As clean_external, without digital-signature marks."""
    return _tidy(F.regexp_replace(line_ends(F.replace(filled(c), F.lit("\x00"), F.lit(" "))), SIGNATURE, " "))


def clean_ocr(c: Column) -> Column:
    """Recognised text: line ends and runs of empty lines only."""
    return strip(few_empty_lines(line_ends(filled(c))))


def visible(c: Column) -> Column:
    """The text without blanks: the frequent ones go by a plain search, the others in runs."""
    return F.regexp_replace(F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")), f"{SP}+", "")


def letter_ratio(c: Column, seen: Column | None = None) -> Column:
    """Letters among visible characters, counted by what is left without runs of others; seen: visible(c), where it is a column already."""
    seen = visible(c) if seen is None else seen
    return F.when(seen != "", F.length(F.regexp_replace(seen, r"\P{L}+", "")) / F.length(seen)).otherwise(0.0)


def symbol_ratio(c: Column, seen: Column | None = None) -> Column:
    seen = visible(c) if seen is None else seen
    return F.when(seen != "", F.length(F.regexp_replace(seen, f"[{ALNUM}]+", "")) / F.length(seen)).otherwise(1.0)


def word_count(c: Column) -> Column:
    """Words become marks, which are counted by length."""
    marked = F.regexp_replace(F.replace(c, F.lit("\x01"), F.lit(" ")), PLAIN_WORD, "\x01")
    return F.length(marked) - F.length(F.replace(marked, F.lit("\x01"), F.lit("")))


def corrupted_accents(c: Column) -> Column:
    return F.when(c.rlike(BAD_ACCENT), F.regexp_count(c, F.lit(BAD_ACCENT))).otherwise(0)


def normalize_date(c: Column, far: bool = False) -> Column:
    """Text or number in text form to YYYY-MM-DD or null: all digits are an epoch (milliseconds beyond 1e10), else the date that the text begins with.

    An epoch beyond year 9999 has no date, since days of longer years don't compare as text; with `far` it has one, of as many digits as its year needs.
    """
    t = strip(c.cast("string"))
    n = F.expr("try_cast(NULL as double)") if c is None else t.try_cast("double")
    seconds = F.when(n > 10_000_000_000, n / 1000).otherwise(n)
    digits = t.rlike("^\\p{Nd}+$")
    last = FAR_DAYS * 86400 if far else 253402300800
    epoch = F.when(seconds < last, F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "y-MM-dd"))
    iso = F.substring(t, 1, 10)
    return F.when(digits, epoch).when(iso.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.substring(iso, 1, 4) > "0000"), iso.try_cast("date").cast("string"))


def numbers(c: Column) -> Column:
    """Numeric expressions with their punctuation dropped."""
    return F.transform(F.regexp_extract_all(filled(c), F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, r"\P{Nd}", ""))


def number_accuracy(answer: Column, expected: Column) -> Column:
    """Null if nothing is expected, else 1.0 if all expected numbers are in the answer, or 0.0."""
    e = numbers(expected)
    return F.when(F.size(e) > 0, (F.size(F.array_except(e, numbers(answer))) == 0).cast("double"))


def _without_marks(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")


def _pairs(blocks) -> dict[str, str]:
    """What becomes of characters whose canonical decomposition, without marks, is another text."""
    return {chr(k): b for lo, hi in blocks for k in range(lo, hi) if not 0xD800 <= k < 0xE000 and (b := _without_marks(chr(k))) != chr(k) and b}


def _class(points: list[int]) -> str:
    """Sorted code points as ranges of a regular expression's class."""
    out = []
    for _, run in itertools.groupby(enumerate(points), lambda x: x[1] - x[0]):
        first, *_, last = [k for _, k in run] * 2
        out.append(f"\\x{{{first:x}}}-\\x{{{last:x}}}" if last > first else f"\\x{{{first:x}}}")
    return "".join(out)


NEAR = _pairs(((0xC0, 0x870), (0x1E00, 0x2000)))
#: Texts of these blocks alone (Latin, Greek, Cyrillic, Hebrew, Arabic and others) need one small table, and the engine's classes are exact for them.
BLOCKS = r"\x{0}-\x{86f}\x{1e00}-\x{206f}\x{20a0}-\x{20b5}"
SYLLABLES, LEADS, VOWELS, TAILS = 0xAC00, 19, 21, 28


#: Planes beyond these hold no letters, digits or marks.
PLANES = ((0x80, 0xD800), (0xE000, 0x40000), (0xE0000, 0xE1000))


@functools.cache
def _far() -> dict:
    """Tables of all scripts, by the rules of the interpreter's Unicode data: what becomes of a character, in lower case and without marks, at once;
    characters that become several; the class of words, and a class of few ranges without syllables, those, or characters on which the engine's own class differs."""
    lower, every, marks, word = {}, {}, [], [*range(48, 58), *range(65, 91), 95, *range(97, 123)]
    for k in itertools.chain(*(range(lo, hi) for lo, hi in PLANES)):
        c = chr(k)
        kind = unicodedata.category(c)
        if kind == "Mn":
            marks.append(k)
        elif kind[0] in "LN":
            word.append(k)
        if (x := c.lower()) != c and len(x) == 1:
            lower[c] = x
        if unicodedata.decomposition(c)[:1] not in ("", "<") and (b := _without_marks(c)) != c and b:
            every[c] = b
    one, several = ({c: b for c, b in every.items() if (len(b) == 1) is single} for single in (True, False))
    gone, pairs = set(map(chr, marks)), {}
    for c in {*lower, *one, *gone}:
        x = lower.get(c, c)
        x = one.get(x, x)
        pairs[c] = "" if x in gone else x
    exact, differs = _beyond(f"{ALNUM}_", word)
    if differs is None:
        return {"pairs": pairs, "several": several, "word": exact, "easy": None}
    odd = sorted({-1, *differs, *map(ord, several), SYLLABLES, SYLLABLES + LEADS * VOWELS * TAILS - 1, 0x110000})
    gaps = [(a + 1, b) for a, b in itertools.pairwise(odd) if a + 1 < b and a != SYLLABLES and a < 0x10000]
    easy = sorted(sorted(gaps, key=lambda x: x[0] - x[1])[:EASY] + [gaps[0]])
    return {"pairs": pairs, "several": several, "word": exact, "easy": "".join(f"\\x{{{a:x}}}-\\x{{{b - 1:x}}}" for a, b in dict.fromkeys(easy))}


#: Ranges of the class of texts that need no other look; each costs time for every character.
EASY = 10


def _beyond(known: str, points: list[int]) -> tuple[str, list[int] | None]:
    """The class `known` with those of the code points that the engine, whose Unicode tables may be older, doesn't count as its members, and without others that it does; and all of these, or None without an engine."""
    context = SparkContext._active_spark_context
    if context is None or context._jvm is None:
        return _class(points), None
    left = lambda pattern, some: context._jvm.java.util.regex.Pattern.compile(pattern).matcher("".join(map(chr, some))).replaceAll("")
    mine = set(points)
    added = [ord(c) for c in left(f"[{known}]", points)]
    taken = [ord(c) for c in left(f"[^{known}]", (k for lo, hi in PLANES for k in range(lo, hi) if k not in mine))]
    more, less = _class(added), _class(taken)
    return f"{known}{more}&&[^{less}]" if less else known + more, added + taken


def _translated(c: Column, pairs: dict[str, str]) -> Column:
    """Each character as what it becomes, of one character or none."""
    last = sorted(pairs, key=lambda x: not pairs[x])
    return F.translate(c, "".join(last), "".join(pairs[x] for x in last))


def _jamo(c: Column) -> Column:
    """Hangul syllables as their letters, by arithmetic."""
    leads, vowels, tails = ("".join(chr(k + i) for i in range(n)) for k, n in ((0x1100, LEADS), (0x1161, VOWELS), (0x11A8, TAILS - 1)))

    def apart(x: Column) -> Column:
        n = F.ascii(x) - SYLLABLES
        tail = n % TAILS
        letter = lambda text, at: F.substr(F.lit(text), at + 1, F.lit(1))
        parts = F.concat(letter(leads, (n / (VOWELS * TAILS)).cast("int")), letter(vowels, ((n % (VOWELS * TAILS)) / TAILS).cast("int")), F.when(tail > 0, letter(tails, tail - 1)).otherwise(""))
        return F.when((n >= 0) & (n < LEADS * VOWELS * TAILS), parts).otherwise(x)

    return F.when(c.rlike(r"[\x{ac00}-\x{d7a3}]"), F.array_join(F.transform(F.split(c, ""), apart), "")).otherwise(c)


def _bound(c: Column, f) -> Column:
    """f(c), with c computed once however often f names it."""
    return F.transform(F.array(c), f)[0]


def _any_script(low: Column) -> Column:
    t = _far()

    def words(c: Column) -> Column:
        whole = F.regexp_replace(_bound(_several(c, t), _jamo), f"[^{t['word']}]+", " ")
        return F.when(c.rlike(f"[^{t['easy']}]"), whole).otherwise(F.regexp_replace(c, f"[^{ALNUM}_]+", " ")) if t["easy"] else whole

    return _bound(_translated(low, t["pairs"]), words)


def _several(c: Column, t: dict) -> Column:
    many = c
    for x, b in t["several"].items():
        many = F.replace(many, F.lit(x), F.lit(b))
    return F.when(c.rlike("[" + "".join(f"\\x{{{ord(x):x}}}" for x in t["several"]) + "]"), many).otherwise(c)


def normalize(c: Column) -> Column:
    """Lower case, canonically decomposed, without marks or punctuation, single spaces, for all of Unicode that the interpreter knows.

    Whatever is no letter, digit or underscore, blanks included, becomes one space. Texts of ASCII alone have no accents to look for,
    those of BLOCKS need one small table; others are looked up in those of all scripts.
    """
    low = F.lower(filled(c))
    plain = F.regexp_replace(low, "[^0-9a-z_]+", " ")
    near = F.regexp_replace(F.regexp_replace(_translated(low, NEAR), r"\p{Mn}+", ""), f"[^{ALNUM}_]+", " ")
    return F.trim(F.when(F.length(low) == F.octet_length(low), plain).when(~low.rlike(f"[^{BLOCKS}]"), near).otherwise(_any_script(low)))


def exactness(answer: Column, expected: Column) -> Column:
    return (normalize(answer) == normalize(expected)).cast("double")
