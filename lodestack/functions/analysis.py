"""Analyzer chains: a tokenizer and ordered filters, each as a column expression and as a plain function for query text.

A field's tokens are one array<string> in position order. A filter that removes a token leaves null in its place, so positions
keep their gaps; the values of a multi-valued field are apart by GAP nulls, so that phrases do not cross them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stemming
from .minhash import bound, minhash_column, minhash_tokens

GAP = 100
#: Ideographs and hiragana, each a word of its own.
ALONE = "\u3041-\u3096\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF"
#: Approximates Unicode word breaks: a run of letters, marks, digits and underscores, joined by an apostrophe or full stop between them,
#: or one of ALONE. The same for plain Python and for the JVM's expressions (COLUMN_WORD, which looks for ASCII first, as most text is).
WORD, COLUMN_WORD = (f"{run}+(?:['’.]{run}+)*|[{ALONE}]" for run in (rf"(?:(?![{ALONE}])[\p{{L}}\p{{M}}\p{{N}}_])", rf"[a-zA-Z0-9_[\p{{L}}\p{{M}}\p{{N}}&&[^{ALONE}]]]"))
LONGEST = 255
#: Fixed value: the usual short list of English stop words.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: Letters without a decomposition that fold to one ASCII letter, and letters that fold to several; the rest is decomposed by rule.
FOLD_ONE = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
FOLD_MANY = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "Æ": "AE", "Œ": "OE", "Þ": "TH"}


def _decomposed() -> dict[str, str]:
    """Latin letters with marks, to the ASCII letter they decompose to."""
    out = dict(FOLD_ONE)
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii() and base.isalpha():
            out[c] = base
    return out


FOLD = _decomposed()
#: British to American spellings; a small list of our own, extended by ``load_spellings``.
SPELLINGS = {
    "analyse": "analyze", "behaviour": "behavior", "catalogue": "catalog", "centre": "center", "cheque": "check", "colour": "color", "defence": "defense",
    "dialogue": "dialog", "favourite": "favorite", "fibre": "fiber", "grey": "gray", "harbour": "harbor", "honour": "honor", "jewellery": "jewelry",
    "labour": "labor", "licence": "license", "litre": "liter", "metre": "meter", "neighbour": "neighbor", "organise": "organize", "plough": "plow",
    "programme": "program", "realise": "realize", "theatre": "theater", "travelling": "traveling", "tumour": "tumor", "tyre": "tire",
}



def load_spellings(path: str) -> None:
    """Adds the British and American spellings of a file, two columns with a tab between (a first line UK, US is skipped)."""
    with open(path, encoding="utf-8") as f:
        pairs = [line.split("\t") for line in f.read().splitlines() if "\t" in line]
    SPELLINGS.update({uk.strip(): us.strip() for uk, us in pairs if (uk, us) != ("UK", "US")})
    _plain_steps.clear()


Tokens = list
ColumnStep = Callable[[Column], Column]
PlainStep = Callable[[Tokens], Tokens]


def _each(f: Callable[[Column], Column]) -> ColumnStep:
    return lambda tokens: F.transform(tokens, f)


def _plain(f: Callable[[str], str | None]) -> PlainStep:
    return lambda tokens: [None if t is None else f(t) for t in tokens]


def fold(text: Column) -> Column:
    """Latin letters without their marks."""
    out = F.translate(text, "".join(FOLD), "".join(FOLD.values()))
    for letter, to in FOLD_MANY.items():
        out = F.replace(out, F.lit(letter), F.lit(to))
    return out


def fold_plain(text: str) -> str:
    return "".join(FOLD_MANY.get(c) or FOLD.get(c, c) for c in text)


def shingles(n: int) -> tuple[ColumnStep, PlainStep]:
    """Word n-grams and nothing else; one that would hold a gap is left out."""

    def groups(tokens: Column) -> Column:
        at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.when(~F.exists(F.slice(tokens, i, n), lambda t: t.isNull()), F.array_join(F.slice(tokens, i, n), " ")))

    def column(tokens: Column) -> Column:
        return bound(tokens, groups)

    def plain(tokens: Tokens) -> Tokens:
        parts = [tokens[i : i + n] for i in range(len(tokens) - n + 1)]
        return [None if None in p else " ".join(p) for p in parts]

    return column, plain


def british_us(spellings: dict[str, str]) -> tuple[ColumnStep, PlainStep]:
    table = lambda: F.create_map(*(F.lit(x) for pair in spellings.items() for x in pair))
    return _each(lambda t: F.coalesce(F.element_at(table(), t), t)), _plain(lambda t: spellings.get(t, t))


def filters() -> dict[str, tuple[ColumnStep, PlainStep]]:
    known = set(STOP_WORDS)
    return {
        "LOWERCASE": (_each(F.lower), _plain(str.lower)),
        "UPPERCASE": (_each(F.upper), _plain(str.upper)),
        "ASCII_FOLDING": (_each(fold), _plain(fold_plain)),
        "STOPWORDS": (_each(lambda t: F.when(~t.isin(*STOP_WORDS), t)), _plain(lambda t: None if t in known else t)),
        "ENGLISH_POSSESSIVE": (_each(lambda t: F.regexp_replace(t, "['’＇][sS]$", "")), _plain(lambda t: regex.sub("['’＇][sS]$", "", t))),
        "ENGLISH_MIN_STEM": (_each(stemming.min_stem_column), _plain(stemming.min_stem)),
        "SNOWBALL_STEM": (stemming.porter2_column, _plain(stemming.porter2)),
        "KSTEM": (stemming.inflection_column, _plain(stemming.inflection_stem)),
        "TWO_TWO_SHINGLE": shingles(2),
        "THREE_THREE_SHINGLE": shingles(3),
        "FOUR_FOUR_SHINGLE": shingles(4),
        "FIVE_FIVE_SHINGLE": shingles(5),
        "MINHASH": (minhash_column, minhash_tokens),
        "BRITISH_US": british_us(SPELLINGS),
        "CONCAT_ALL": (_each(lambda t: F.nullif(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""), F.lit(""))), _plain(lambda t: regex.sub(r"[^\p{L}\p{N}]", "", t) or None)),
    }


def tokenizers() -> dict[str, tuple[ColumnStep, Callable[[str], Tokens]]]:
    def standard(text: str) -> Tokens:
        return [t for t in regex.findall(WORD, text) if len(t) <= LONGEST]

    return {
        "KEYWORD": (lambda c: F.array(c), lambda s: [s]),
        "WHITESPACE": (lambda c: F.filter(F.split(c, r"\s+"), lambda t: t != ""), str.split),
        "STANDARD": (lambda c: F.filter(F.regexp_extract_all(c, F.lit(COLUMN_WORD), F.lit(0)), lambda t: F.length(t) <= LONGEST), standard),
    }


@dataclass
class Analyzer:
    """A named chain; ``similarity`` is BM25, TFIDF, TF or CONSTANT."""

    name: str
    tokenizer: str = "STANDARD"
    filters: list[str] = field(default_factory=list)
    similarity: str = "BM25"
    query_handling: str = "NORMAL"  # NORMAL or MINHASH_QUERY; kept with the settings, and of no effect on queries

    def __post_init__(self) -> None:
        if self.query_handling not in ("NORMAL", "MINHASH_QUERY"):
            raise ValueError(f"analyzer {self.name}: unknown query handling {self.query_handling}")
        if self.tokenizer not in tokenizers() or any(f not in FILTER_NAMES for f in self.filters):
            raise ValueError(f"analyzer {self.name}: unknown tokenizer or filter")
        if self.similarity not in ("BM25", "TFIDF", "TF", "CONSTANT"):
            raise ValueError(f"analyzer {self.name}: unknown similarity {self.similarity}")

    def column(self, values: Column) -> Column:
        """Tokens of an array<string> of values; null where there is no value."""
        tokenize, steps = tokenizers()[self.tokenizer][0], filters()
        gap = F.array_repeat(F.lit(None).cast("string"), GAP)
        tokens = F.flatten(F.transform(values, lambda v, i: F.when(i > 0, F.concat(gap, tokenize(v))).otherwise(tokenize(v))))
        for name in self.filters:
            tokens = steps[name][0](tokens)
        return tokens

    def tokens(self, text: str) -> Tokens:
        """The same for query text on the driver."""
        out, steps = tokenizers()[self.tokenizer][1](text), filters_plain()
        for name in self.filters:
            out = steps[name](out)
        return out

    def normalize(self, term: str) -> str:
        """Character-level filters only, for terms with wildcards, prefixes and fuzzy terms."""
        steps = filters_plain()
        for name in self.filters:
            if name in ("LOWERCASE", "UPPERCASE", "ASCII_FOLDING"):
                term = steps[name]([term])[0]
        return term


FILTER_NAMES = (
    "LOWERCASE", "UPPERCASE", "ASCII_FOLDING", "STOPWORDS", "ENGLISH_POSSESSIVE", "ENGLISH_MIN_STEM", "SNOWBALL_STEM", "KSTEM", "TWO_TWO_SHINGLE",
    "THREE_THREE_SHINGLE", "FOUR_FOUR_SHINGLE", "FIVE_FIVE_SHINGLE", "MINHASH", "BRITISH_US", "CONCAT_ALL",
)
_plain_steps: dict[str, PlainStep] = {}


def filters_plain() -> dict[str, PlainStep]:
    if not _plain_steps:
        _plain_steps.update({k: v[1] for k, v in filters().items()})
    return _plain_steps


def built_in() -> dict[str, Analyzer]:
    """The predefined chains; a definition of the same name replaces one."""
    chains = {
        "standard": ("STANDARD", ["LOWERCASE", "STOPWORDS"]),
        "keyword": ("KEYWORD", []),
        "lcKeyword": ("KEYWORD", ["LOWERCASE"]),
        "minStem": ("STANDARD", ["LOWERCASE", "STOPWORDS", "ENGLISH_MIN_STEM"]),
        "kstem": ("STANDARD", ["LOWERCASE", "STOPWORDS", "KSTEM"]),
        "twoTwoShingle": ("STANDARD", ["LOWERCASE", "STOPWORDS", "TWO_TWO_SHINGLE"]),
        "threeThreeShingle": ("STANDARD", ["LOWERCASE", "STOPWORDS", "THREE_THREE_SHINGLE"]),
        "lcConcatAll": ("KEYWORD", ["LOWERCASE", "CONCAT_ALL"]),
        "lsh": ("STANDARD", ["LOWERCASE", "ASCII_FOLDING", "KSTEM", "STOPWORDS", "FIVE_FIVE_SHINGLE", "MINHASH"]),
    }
    out = {name: Analyzer(name, tokenizer, steps) for name, (tokenizer, steps) in chains.items()}
    out["lsh"].similarity = "CONSTANT"
    return out
