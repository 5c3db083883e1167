"""Strings: white space, paths, templates, chat prompts, truncation, normalisation."""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings at which a generation is cut, the first two with a literal backslash.
STOPS = ("<\\s>", "\\n", "\n", "<END>")
#: The chat template's markers and the pattern of a default prompt.
CHAT_START, CHAT_END = "<|im_start|>", "<|im_end|>"
DEFAULT_TEMPLATE = "Speech: {dsu_seq}\nEnglish:"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends (``trim`` knows spaces only)."""
    return F.regexp_replace(_col(x), r"(?U)^[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$", "")


def first_field(x: Column | str, separator: str = "\t") -> Column:
    return F.element_at(F.split(_col(x), separator, 2), 1)


def split_commas(x: Column | str) -> Column:
    return F.split(_col(x), ",")


def basename(x: Column | str) -> Column:
    return F.regexp_extract(_col(x), r"([^/]*)$", 1)


def stem(x: Column | str) -> Column:
    """The basename without its extension; dots at the start of a name don't begin one."""
    return F.regexp_replace(basename(x), r"^(\.*[^.].*)\.[^.]*$", "$1")


def last_part(x: Column | str, separator: str = "_") -> Column:
    """What stands after the last separator of the stem (the whole stem without one)."""
    return F.element_at(F.split(stem(x), separator), -1)


def path_join(root: Column | str, path: Column | str) -> Column:
    """``path`` below ``root``; an absolute path stays as it is."""
    root, path = _col(root), _col(path)
    joined = F.when((root == "") | root.endswith("/"), F.concat(root, path)).otherwise(F.concat(root, F.lit("/"), path))
    return F.when(path.startswith("/"), path).otherwise(joined)


def contains_any(x: Column | str, cases: Mapping[str, Column], default: Column) -> Column:
    """The value of the first key that occurs in x (S24)."""
    out = default
    for key, value in reversed(list(cases.items())):
        out = F.when(_col(x).contains(key), value).otherwise(out)
    return out


def fill(template: str, slots: Mapping[str, Column]) -> Column:
    """A template with named slots (``{name}``, repeats allowed; ``{{`` and ``}}`` are braces).

    The template is taken apart here, so a slot's value is never looked at for further slots.
    """
    parts = []
    for literal, name, spec, conversion in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if spec or conversion or name not in slots:
                raise KeyError(f"the template's slot {name!r} isn't given or has a format")
            parts.append(_col(slots[name]).cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def chat_prompt(messages: Column | str, generate: bool = True) -> Column:
    """Ordered array<struct<role, text>> as one chat prompt.

    Every message ends with its mark and a line end, but the last one where no answer is to follow. The assistant's
    start follows if asked for and the last message isn't the assistant's.
    """
    messages = _col(messages)
    n = F.size(messages)
    ends = (lambda i: F.lit(True)) if generate else (lambda i: i < n - 1)
    body = F.array_join(F.transform(messages, lambda m, i: F.concat(F.lit(CHAT_START), m["role"], F.lit("\n"), m["text"], F.when(ends(i), CHAT_END + "\n").otherwise(""))), "")
    if not generate:
        return body
    return F.concat(body, F.when((n == 0) | (F.try_element_at(messages, F.lit(-1))["role"] != "assistant"), f"{CHAT_START}assistant\n").otherwise(""))


def cut_at_stop(x: Column | str, stops: tuple[str, ...] = STOPS) -> Column:
    """The text before the first stop string."""
    pattern = "|".join("\\Q" + s + "\\E" for s in stops)
    return F.element_at(F.split(_col(x), pattern, 2), 1)


def normalize_basic(x: Column | str) -> Column:
    """Lower case, without bracketed parts, symbols as spaces, single spaces. Without NFKC, see ``normalize_nfkc``.

    Letters, digits and white space stay; marks, symbols and punctuation become spaces.
    """
    out = F.lower(_col(x))
    out = F.regexp_replace(out, r"[<\[][^>\]]*[>\]]", "")
    out = F.regexp_replace(out, r"\(([^)]+?)\)", "")
    out = F.regexp_replace(out, r"[\p{M}\p{S}\p{P}]", " ")
    return F.regexp_replace(out, r"(?U)\s+", " ")


def normalize_nfkc() -> Callable[[Column], Column]:
    """NFKC, for which Spark has no function: an Arrow-batched pandas function."""
    import unicodedata

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return nfkc


def normalize(x: Column | str) -> Column:
    """The basic normaliser with NFKC between the removal of brackets and that of symbols."""
    out = F.regexp_replace(F.regexp_replace(F.lower(_col(x)), r"[<\[][^>\]]*[>\]]", ""), r"\(([^)]+?)\)", "")
    out = F.regexp_replace(normalize_nfkc()(out), r"[\p{M}\p{S}\p{P}]", " ")
    return F.regexp_replace(F.lower(out), r"(?U)\s+", " ")


#: Fixed values of the English normaliser: the contractions, titles and tenses of the public Whisper English text
#: normaliser (openai/whisper, MIT licence), as (pattern, replacement), in its order.
ENGLISH = (
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "can not"), (r"\blet's\b", "let us"), (r"\bain't\b", "aint"), (r"\by'all\b", "you all"),
    (r"\bwanna\b", "want to"), (r"\bgotta\b", "got to"), (r"\bgonna\b", "going to"), (r"\bi'ma\b", "i am going to"), (r"\bimma\b", "i am going to"),
    (r"\bwoulda\b", "would have"), (r"\bcoulda\b", "could have"), (r"\bshoulda\b", "should have"), (r"\bma'am\b", "madam"),
    (r"\bmr\b", "mister "), (r"\bmrs\b", "missus "), (r"\bst\b", "saint "), (r"\bdr\b", "doctor "), (r"\bprof\b", "professor "), (r"\bcapt\b", "captain "),
    (r"\bgov\b", "governor "), (r"\bald\b", "alderman "), (r"\bgen\b", "general "), (r"\bsen\b", "senator "), (r"\brep\b", "representative "),
    (r"\bpres\b", "president "), (r"\brev\b", "reverend "), (r"\bhon\b", "honorable "), (r"\basst\b", "assistant "), (r"\bassoc\b", "associate "),
    (r"\blt\b", "lieutenant "), (r"\bcol\b", "colonel "), (r"\bjr\b", "junior "), (r"\bsr\b", "senior "), (r"\besq\b", "esquire "),
    (r"'d been\b", " had been"), (r"'s been\b", " has been"), (r"'d gone\b", " had gone"), (r"'s gone\b", " has gone"), (r"'d done\b", " had done"), (r"'s got\b", " has got"),
    (r"n't\b", " not"), (r"'re\b", " are"), (r"'s\b", " is"), (r"'d\b", " would"), (r"'ll\b", " will"), (r"'t\b", " not"), (r"'ve\b", " have"), (r"'m\b", " am"),
)
FILLERS = r"\b(hmm|mm|mhm|mmm|uh|um)\b"


def normalize_english(x: Column | str) -> Column:
    """Lower case, no brackets, fillers dropped, contractions spelt out, symbols as spaces.

    Numbers in words and British spellings are left as they are: their tables are not part of this library.
    """
    out = F.lower(_col(x))
    out = F.regexp_replace(F.regexp_replace(out, r"[<\[][^>\]]*[>\]]", ""), r"\(([^)]+?)\)", "")
    out = F.regexp_replace(F.regexp_replace(out, f"(?U){FILLERS}", ""), r"\s+'", "'")
    for pattern, plain in ENGLISH:  # (?U): word ends are those of all scripts
        out = F.regexp_replace(out, f"(?U){pattern}", plain)
    out = F.regexp_replace(F.regexp_replace(out, r"(\d),(\d)", "$1$2"), r"\.([^0-9]|$)", " $1")
    out = F.regexp_replace(out, r"[\p{M}\p{S}\p{P}&&[^.%$¢€£]]", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[.$¢€£]([^0-9])", " $1"), r"([^0-9])%", "$1 ")
    return F.regexp_replace(out, r"(?U)\s+", " ")
