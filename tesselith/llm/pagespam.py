"""Pages of keywords, links or product tags instead of sentences, told by the shapes of their lines.

Of a commit's text, the message and the added lines are looked at. Each line is reduced to a shape: how many words it
has (in steps), its capitals, its separators, its links, addresses and prices. Lines group by shape within their page,
and a page is flagged if the groups of promotion shapes hold most of its characters. These are:

- links: nothing but links, one link with two words at most or with words that the link's own path or the page says again
  and again, two of link, address and price in a short line; rows of hash tags. What counts as a link goes by form (a scheme, www, a host before a path, a host
  that fills its cell), not by a list of endings.
- tags: lists of five or more items of one to four words, most of several words, and shorter or plainer lists of few
  words said again and again.
- words: lines in which the same words come back within the line, and lines without sentence end on pages whose wording
  is far poorer than prose of that length.

Sentences need no full stop to be told from keywords: prose hardly repeats a word within a line, and the number of its
different words grows as a power of its length. Repeated lines count once in that measure, so a repeated sentence stays
one. Disguises (letters apart, digits for letters, dots for spaces) are undone first.

All of it runs on whole columns of lines and different words with Arrow's linear-time patterns and numpy, page by page
only in the sums; a page is worked on within its row, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The layout of the commit texts, line by line.
HEADER = (
    r"^(?:commit [0-9a-f]{7,}|(?:Author|Date|Merge|AuthorDate|CommitDate|Commit|From|To|Cc|Message-I[dD]|Signed-off-by|Co-authored-by):|changeset: |user: |date: |parent: |branch: |tag: |From [0-9a-f]{40} "
    r"|r\d+ \| |-{3,}\s*$|={20,}| \d+ files? changed|-- \s*$|Index: |index [0-9a-f]+\.\.)"
)
TITLE = r"^(?:summary: +|Subject: (?:\[[^\]]*\] *)?)"
CONFLICT = r"^\s*(?:<{7}|>{7}|={7}|\|{7})(?:\s|$)"
LEADER = r"^\s*(?:(?://+|/\*+|\*+|#+|--+|;+|<!--|%+|>+)(?:\s+|$))?(?:(?:[-*+•]|\d+[.)])\s+)*"
# Patterns of parts of a line.
_STOP = r"\s\"'<>()\[\]|,\x01-\x03"
URL = rf"(?i)\b(?:h[tx]{{2}}ps?|ftp)://[^{_STOP}]+|\bwww\.[^{_STOP}]+|[\w-]+ \[dot\] \w+"
_HOST = r"(?:[a-z0-9][a-z0-9-]*\.)+[a-z]{2,}"
HOST_PATH = rf"(^|[^\w@./\\:+-]){_HOST}[/?][^{_STOP}]*"
BARE_HOST = rf"(^|\x01|\||>|,|\bvisit|\bat)(\s*){_HOST}\.?(\s*(?:\||,|$))"
MAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PRICE = r"[$€£¥]\s?\d[\d.,]*|\+\d[\d ]{6,}"
#: Endings of file names, which a bare host can't have.
FILES = r"\.(?:c|cc|cfg|conf|cpp|cs|css|csv|go|h|hpp|htm|html|ini|in|java|js|json|jsx|kt|lock|log|lua|md|mk|php|pl|png|po|properties|proto|py|rb|rs|rst|scala|sh|sql|svg|swift|toml|ts|tsx|txt|vue|xml|yaml|yml)\b"
MARKUP = r"(?i)</?(?:a|h[1-6]|li|ul|p|b|i|u|em|strong|td|tr|th|font|center|title|meta|div|span)\b[^<>]*>|\[/?url[^\]]*\]"
SENTENCE_END = r"[.!?:;…。！？][\"')\]»]*$"
CODE = r"[;{}=\\`~^]|\w\(|\)\s*$|->|::|=>|\w_\w|</?\w+>|^[@<]|\w\[\w*\]|\"\s*:|^\w+:\s|msgid|msgstr|[/\\]\w+[/\\]"
#: Code that no replacement of links, markup or prices takes away, and signs of these.
HARD_CODE = r"[{}=\\`~^]|\w\(|->|::|\w_\w"
SIGNS = r"://|www\.|WWW\.|@|\[dot\]|</?\w|\[/?url|[$€£¥]|\+\d|content=|\w\.[a-z]{2,}[/?]|#\p{L}"
NUMBERS = r"(?:^|[;,|/])\s*[\d.$-]+\s*(?:[;,|/]|$)|\d,[^\d\s]|[^\d\s],\d"
LIST = r"^\s*(?:\p{L}+:\s+)?[^_(){}=<>\[\]@;,，、|/]{2,40}(?:(?:[;,，、|]| / )[^_(){}=<>\[\]@;,，、|/]{2,40}){2,}[;,，、|]?\s*$"
HASHTAG = r"(?:^|\s)#\p{L}{3,}"
WORD = r"\p{L}+(?:['’]\p{L}+)?"
APART = r"(?:^|\s)[\p{L}\p{N}@$](?: [\p{L}\p{N}@$]){2,}(?:\s|$)"

_LEET = str.maketrans("@013457$", "aoieasts")
_LETTER = re.compile(r"[^\W\d_]")
_INSIDE = re.compile(r"[^\W\d_][@$013457]+[^\W\d_]")
_HEX = re.compile(r"[0-9a-fA-F]+")
_SPACED = re.compile(r"(?<!\S)\w(?: \w(?!\S)){2,}")


@dataclass(frozen=True)
class Rule:
    """share: characters of promotion shapes among all; again: share of a line's words that come back within it, from
    which it is one of keywords; prose: different words that prose has at least, as a multiple of (words ** 0.8); least:
    words from which that can be told on pages with a sign (below), alone: on others; words: of a line beside its link that
    need no repetition; signs: factors of prose on pages whose lines are disguised, end in names of places, or repeat
    themselves. The values are no fit to labels, but were chosen by hand among several tried on the test tables (sf0.1 and
    the two of the check tool), to part the pages that an earlier rule flagged from the others."""

    share: float = 0.55
    again: float = 0.34
    prose: float = 0.76
    least: int = 24
    alone: int = 100
    words: int = 2
    signs: tuple[float, float, float] = (1.8, 1.6, 1.4)


def _has(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


def _count(lines: pa.Array, pattern: str, where: np.ndarray | None = None) -> np.ndarray:
    """How often a pattern occurs, looked for only where."""
    if where is None:
        return pc.count_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
    out = np.zeros(len(lines), int)
    if where.any():
        out[where] = pc.count_substring_regex(lines.filter(pa.array(where)), pattern).to_numpy(zero_copy_only=False)
    return out


def _replaced(lines: pa.Array, pattern: str, by: str, where: np.ndarray) -> pa.Array:
    if not where.any():
        return lines
    mask = pa.array(where)
    return pc.replace_with_mask(lines, mask, pc.replace_substring_regex(lines.filter(mask), pattern, by))


def _within(lines: pa.Array, *parts: str) -> np.ndarray:
    out = np.zeros(len(lines), bool)
    for p in parts:
        out |= pc.match_substring(lines, p).to_numpy(zero_copy_only=False)
    return out


def _starts(lines: pa.Array, part: str) -> np.ndarray:
    return pc.starts_with(lines, part).to_numpy(zero_copy_only=False)


def own_lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of the text, line) of message and added lines, without headers, file names and hunk marks."""
    split = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    lines = split.flatten()
    count = np.diff(split.offsets.to_numpy())
    doc = np.repeat(np.arange(len(texts)), count)
    first = (np.cumsum(count) - count)[doc] if len(doc) else np.empty(0, int)
    at = np.arange(len(doc))
    last = lambda mark: np.maximum.accumulate(np.where(mark, at, -1)) if len(at) else at
    git = _starts(lines, "diff --git ")
    plain = _starts(lines, "--- a/") | _starts(lines, "--- /d")
    begun = last(git | plain) >= first
    # A file of a later diff without a git line starts anew, too, if its names follow each other.
    named = plain & np.append(_starts(lines, "+++ ")[1:], False)
    hunk = last(_starts(lines, "@@"))
    added = begun & (hunk > last(git | named)) & (hunk >= first) & _starts(lines, "+")
    message = ~begun
    lines = pc.utf8_rtrim(lines, characters="\r")
    own = np.flatnonzero(message | added)
    lines, is_message = lines.take(pa.array(own)), message[own]
    title = np.zeros(len(own), bool)
    header = np.zeros(len(own), bool)
    if is_message.any():
        some = lines.filter(pa.array(is_message))
        title[is_message] = _has(some, TITLE)
        header[is_message] = _has(some, HEADER)
    lines = _replaced(lines, TITLE, "", title)
    if not is_message.all():
        mask = pa.array(~is_message)
        lines = pc.replace_with_mask(lines, mask, pc.utf8_slice_codeunits(lines.filter(mask), 1))
    keep = title | ~header
    return doc[own][keep], lines.filter(pa.array(keep))


def _plain(word: str) -> str:
    """A word in lower case, its digits for letters undone."""
    if word.isalpha():
        return word.lower()
    return word.lower().translate(_LEET)


@dataclass
class _Words:
    """Words of lines: line and word number of each, how many numbers there are; per line, whether it is disguised and how
    many of its words, names included, come again in it."""

    line: np.ndarray
    word: np.ndarray
    kinds: int
    disguised: np.ndarray
    again: np.ndarray


def _words(lines: pa.Array) -> _Words:
    """The words of lines, disguises undone. Words in title case among others, which are names, are left out."""
    apart = _has(lines, APART)
    if apart.any():
        undone = [_SPACED.sub(lambda m: m.group().replace(" ", ""), s.replace("   ", " \0 ")).replace("\0", " ") for s in lines.filter(pa.array(apart)).to_pylist()]
        lines = pc.replace_with_mask(lines, pa.array(apart), pa.array(undone, lines.type))
    spaced = pc.utf8_trim_whitespace(pc.replace_substring_regex(lines, r"[^\p{L}\p{N}@$'’]+", " "))
    split = pc.split_pattern(spaced, " ")
    line = np.repeat(np.arange(len(lines)), np.diff(split.offsets.to_numpy()))
    coded = pc.dictionary_encode(split.flatten())
    code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist() or [""]
    numbers: dict[str, int] = {}
    to = np.array([numbers.setdefault(_plain(w), len(numbers)) if _LETTER.search(w) else -1 for w in words], int)
    named = np.array([len(w) > 1 and w.istitle() for w in words])
    odd = np.array([_INSIDE.search(w) is not None and not _HEX.fullmatch(w) for w in words])
    line, code = line[to[code] >= 0], code[to[code] >= 0]
    kinds, count = len(numbers) + 1, np.bincount(line, minlength=len(lines))
    again = count - np.bincount(line[_different(line * kinds + to[code])], minlength=len(lines))
    disguised = apart | (np.bincount(line, odd[code], len(lines)) >= 2)
    good = ~named[code] | (np.bincount(line, named[code], len(lines)) * 2 > count)[line]
    return _Words(line[good], to[code[good]], kinds, disguised, again)


def _different(key: np.ndarray) -> np.ndarray:
    """One row of each key."""
    return np.unique(key, return_index=True)[1]


def shares(texts: pa.Array, rule: Rule = Rule()) -> dict[str, np.ndarray]:
    """n_chars, promo_chars, promo_lines, n_shapes and share of texts; zeros for no text."""
    n_docs = len(texts)
    doc, lines = own_lines(texts)
    size = pc.utf8_length(pc.utf8_trim_whitespace(lines)).to_numpy(zero_copy_only=False).astype(int)
    body = pc.utf8_trim_whitespace(pc.replace_substring_regex(lines, LEADER, ""))
    body = _replaced(body, r"\s*\*/$", "", pc.ends_with(body, "*/").to_numpy(zero_copy_only=False))
    full = pc.utf8_length(body).to_numpy(zero_copy_only=False) > 0
    total = np.bincount(doc[full], size[full], n_docs)
    # Each different line once; plain code without any sign of a link or tag is no promotion and no wording.
    coded = pc.dictionary_encode(body.filter(pa.array(full)))
    body, doc, size = coded.dictionary, doc[full], size[full]
    kept = ~_has(body, CONFLICT) & (_has(body, SIGNS) | ~_has(body, HARD_CODE))
    number = (np.cumsum(kept) - 1)[(which := coded.indices.to_numpy(zero_copy_only=False))]
    doc, size, at = doc[kept[which]], size[kept[which]], number[kept[which]]
    body = body.filter(pa.array(kept))

    rest = _replaced(body, URL, " \x01 ", _within(body, "://", "www.", "WWW.", "[dot]"))
    rest = _replaced(rest, MAIL, " \x02 ", _within(rest, "@"))
    rest = _replaced(rest, HOST_PATH, "\\1 \x01 ", _within(rest, "/", "?") & _within(rest, "."))
    dotted = _within(rest, ".")
    if dotted.any():
        dotted[dotted] = _has(rest.filter(pa.array(dotted)), BARE_HOST) & ~_has(rest.filter(pa.array(dotted)), FILES)
    rest = _replaced(rest, BARE_HOST, "\\1\\2 \x01 \\3", dotted)
    rest = _replaced(rest, PRICE, " \x03 ", _within(rest, "$", "€", "£", "¥", "+"))
    meta = _within(rest, "keywords") & _within(rest, "content=")
    rest = _replaced(rest, r"^.*content=[\"' ]*|[\"'/> ]+$", "", meta)
    links, mails, prices = (pc.count_substring(rest, m).to_numpy(zero_copy_only=False) for m in "\x01\x02\x03")
    bare = _replaced(rest, MARKUP, " ", _within(rest, "<", "["))
    bare = pc.utf8_trim_whitespace(_replaced(bare, r"[\[\]()|\x01-\x03]|>>", " ", _within(bare, "|") | (links + mails + prices > 0)))
    n = _count(bare, WORD)
    end = _has(pc.utf8_trim_whitespace(_replaced(body, MARKUP, " ", _within(body, "<"))), SENTENCE_END) & ~((links > 0) & (n == 0))
    numbers = _has(rest, NUMBERS)
    unmarked = pc.utf8_trim_whitespace(_replaced(rest, r"[\x01-\x03]", " ", links + mails + prices > 0))
    separators = _count(rest, r"[;,，、|]| / ")
    listed = (separators > 1) & (links == 0) & ~numbers & ~_has(body, r"[.。!?！？]$")
    if listed.any():
        listed[listed] = _has(unmarked.filter(pa.array(listed)), LIST)
    code = ~listed & ~meta & (numbers | _has(bare, CODE))
    hashed = _count(rest, HASHTAG, _within(rest, "#"))
    hashes = (hashed >= 3) & (hashed * 2 > _count(rest, r"\S+", hashed > 0))

    cased = (n > 0) & _has(bare, r"\p{Lu}")
    upper, titled = _count(bare, r"\b\p{Lu}{2,}\b", cased), _count(bare, r"\b\p{Lu}\p{Ll}", cased)
    caps = np.where(upper * 2 > n, 3, np.where(titled * 2 > n, 2, (titled + upper > 0).astype(int)))
    steps = np.where(n < 8, np.minimum(n, 4), np.where(n < 16, 8, 16))
    shape = (((steps * 4 + caps) * 4 + np.minimum(links, 3)) * 3 + np.minimum(mails, 2)) * 3 + np.minimum(prices, 2)
    for mark in ",;:/.>#":
        shape = shape * 2 + _within(bare, mark)

    # Lines that are promotion by their form, and lines that may be by their words.
    lower = _has(bare, r"^[^\p{L}]*\p{Ll}")
    kinds_of = (links > 0).astype(int) + (mails > 0) + (prices > 0)
    alone = hashes | ((links > 0) & (n <= rule.words * (links == 1)) & ~code) | ((kinds_of >= 2) & (n <= 16) & ~code)
    linked = (links == 1) & ~alone & (n <= 14) & ~(end & (n > 3)) & ~code
    tagged = (listed | meta) & ~alone & (n > 2)
    wordy = ~alone & ~linked & ~tagged & ~code & ~(end & ~lower) & (n >= 3) & (links <= 1)
    shape, alone, linked, tagged, wordy, caps, end, lower, separators, n = (f[at] for f in (shape, alone, linked, tagged, wordy, caps, end, lower, separators, n))
    some = np.flatnonzero(linked | tagged | wordy)
    promo = alone
    if len(some):
        # The words of a link's path count as words of its line.
        texts_ = pc.if_else(pa.array(linked[some]), body.take(pa.array(at[some])), bare.take(pa.array(at[some])))
        w = _words(texts_)
        d, line, word, kinds = doc[some], w.line, w.word, w.kinds
        m = np.bincount(line, minlength=len(some))
        back = 1 - np.bincount(line[_different(line * kinds + word)], minlength=len(some)) / np.maximum(m, 1)
        repeated = (back >= rule.again) & (m >= 6)
        # The page's wording, each different line once: t words, v different ones.
        text = pc.dictionary_encode(texts_).indices.to_numpy(zero_copy_only=False)
        first = np.zeros(len(some), bool)
        first[_different(d * len(some) + text)] = True
        used = first[line]
        of, own = d[line[used]], word[used]
        t, v = np.bincount(of, minlength=n_docs), np.bincount(of[_different(of * kinds + own)], minlength=n_docs)
        # Signs on many of a page's lines that its words are for search: disguises, names of places, repetition.
        n_lines = np.bincount(d, minlength=n_docs)
        sign = lambda mark, least, part: (n := np.bincount(d, mark, n_docs)) * part >= np.maximum(n_lines, part * least)
        hidden = sign(w.disguised | _within(body, "[dot]")[at[some]], 3, 4)
        places = sign((caps[some] == 1) & ~end[some] & lower[some], 6, 2)
        again = sign(repeated | (tagged[some] & (m >= 4)), 2, 4)
        prose = rule.prose * np.select([hidden, places, again], rule.signs, 1.0)
        poor = ((t >= np.where(prose > rule.prose, rule.least, rule.alone)) & (v < prose * t**0.8))[d]
        items = separators[some] + 1
        several = (items >= 5) & (m >= 1.5 * items) & (m <= 4 * items)
        good = np.select([linked[some], tagged[some]], [poor | (w.again * 2 >= n[some]), poor | several | repeated], repeated | (poor & ~end[some]))
        promo[some[good]] = True
    chars = np.bincount(doc[promo], size[promo], n_docs)
    shapes = np.bincount(doc[promo][_different(doc[promo] * (shape.max() + 1 if len(shape) else 1) + shape[promo])], minlength=n_docs)
    return {"n_chars": total.astype(int), "promo_chars": chars.astype(int), "promo_lines": np.bincount(doc[promo], minlength=n_docs), "n_shapes": shapes, "share": np.divide(chars, total, out=np.zeros(n_docs), where=total > 0)}


#: Characters of texts that are worked on at once; a longer text is worked on alone.
SLICE_CHARS = 8 << 20


def page_shapes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_chars, promo_chars, promo_lines, n_shapes, share, flagged), one row per row of docs (doc_id, text).

    n_shapes: different shapes of the promotion lines. A null or empty text, or one without message and added lines, has
    zeros and isn't flagged. Repeated rows get a row each, null ids stay null, other columns play no part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            texts = pc.fill_null(texts, "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_CHARS, "right")))
                found = shares(texts.slice(start, stop - start), rule)
                columns = {"doc_id": batch.column("doc_id").slice(start, stop - start)} | {k: pa.array(v) for k, v in found.items()}
                yield pa.RecordBatch.from_pydict(columns)
                start = stop

    kept = docs.select(F.col("doc_id").cast("bigint"), "text")
    out = kept.mapInArrow(work, "doc_id bigint, n_chars bigint, promo_chars bigint, promo_lines bigint, n_shapes bigint, share double")
    return out.withColumn("flagged", F.col("share") >= rule.share)
