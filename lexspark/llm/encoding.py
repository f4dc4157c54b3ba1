"""Garbled text from wrong character encodings: a hidden Markov model over the characters of a text.

States: one clean state, one state per (true encoding, wrong decoding) pair, and one for characters that are lost.
A pair's state emits what the clean state would emit after the pair's inverse transform: the one to nine characters
that the wrong decoding made of a true one are emitted together, with the clean language model's probability of that
true character after the one before it.  The state may change between any two characters, so a clean word joined to a
garbled one keeps its own state.  The clean model is a character-bigram model, counted over all documents that hold
no doubtful character.  Transitions start from a prior and are trained on the Viterbi labels of all texts.
Viterbi labels the characters of every text; each labelled span gets its state's inverse transform.

Scale: two scans of the text.  The second counts the transitions under the prior and writes down the texts of which
some token might be garbled under any transitions, as all others are clean; only those are labelled again, by a model
that keeps what a worker knows of the tokens.  The bigram counts are summed per task and reach the driver as at most K*K numbers (K = ``len(_SYMBOLS)`` + 1, about 270, fixed); so do the counts of transitions.  The paths through a
token (a run without blanks) are summed up in a small matrix that is worked out once per task and distinct token, over
the states that explain some token of the text better than the clean one; a text without such a token is clean.  No shuffle but that of the counts.

Defined results of odd input: null and empty text is clean and stays as it is; text without accents, in capitals or
in decomposed Unicode and rare but correct symbols are clean; a span whose characters are lost (U+FFFD) is reported
and restored as far as its bytes are left.
"""

from __future__ import annotations

import gc
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from copy import copy
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.runtime import stored

_BASE = "aăâeêioôơuưy"
_MARKS = "̣̀́̃̉"
VIET = "".join(sorted({c for b in _BASE for m in ("", *_MARKS) for c in (unicodedata.normalize("NFC", b + m), unicodedata.normalize("NFC", b + m).upper())} - set("aeiouyAEIOUY") | set("đĐ")))
_COMBINING = "̛̣̀́̂̃̆̉"
_PLAIN = "“”‘’–—…§€«»•°"
_ASCII = "".join(map(chr, range(33, 127)))
_LATIN = "".join(c for c in "çœæïîëûüöäåñøßÿÇŒÆÏÎËÛÜÖÄÅÑØŸ" if c not in VIET)
_SYMBOLS = _ASCII + VIET + _COMBINING + _PLAIN + _LATIN
_INDEX = {c: k + 1 for k, c in enumerate(_SYMBOLS)}  # 0: blank or edge of a token; K: any other character
_K = len(_SYMBOLS) + 2
_OTHER = _K - 1
_LUT = np.full(0x11000, _OTHER, np.int32)
for _c, _i in _INDEX.items():
    _LUT[ord(_c)] = _i
for _c in " \t\n\r":
    _LUT[ord(_c)] = 0

_SYMBOL = np.array([" ", *_SYMBOLS, "\uffff"])
_LETTER = np.array([c.isalpha() or c in _COMBINING for c in _SYMBOL])
_SIGN = np.isin(_SYMBOL, list(_PLAIN.replace("’", "")))
_ENDING = np.isin(_SYMBOL, list(" .,;:!?)]”"))
_FOREIGN = np.isin(_SYMBOL, list(_LATIN))
_MARK = np.arange(_K) == _INDEX["?"]
#: Neighbours that no Vietnamese syllable holds but that encodings with separate marks make.
_CLASH = np.zeros((_K, _K), bool)
for _first, _second in (("aA", "âÂùøûõïåäêëüéèáàãú"), ("eoEO", "âÂ"), ("eE", "ùøûõï")):
    for _a in _first:
        for _b in _second:
            _CLASH[_INDEX[_a], _INDEX[_b]] = True
_PIECE = 1_000_000  # characters handled at once


def _pieces(texts: pd.Series) -> Iterator[pd.Series]:
    """Runs of texts of about ``_PIECE`` characters; a longer text is a piece of its own."""
    ends = texts.str.len().cumsum().to_numpy() // _PIECE
    for _, part in texts.groupby(ends, sort=False):
        yield part


def _classes(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Symbol classes of the texts, each between two blanks, and where each text begins."""
    codes = np.frombuffer(("  " + "  ".join(texts) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(texts.str.len().to_numpy()[:-1] + 2)])
    return _LUT[np.minimum(codes, len(_LUT) - 1)], starts


def doubtful(at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text: whether it holds a sign of a wrong decoding, or what might be one (letters of other languages).

    Signs are characters outside the model, a punctuation sign inside a word, clashing neighbours, and a question
    mark between letters.
    """
    letter = _LETTER[at]
    sign = at == _OTHER
    sign[1:-1] |= letter[:-2] & ((_SIGN[at[1:-1]] & ~_ENDING[at[2:]]) | (_MARK[at[1:-1]] & letter[2:]))
    sign[:-1] |= _CLASH[at[:-1], at[1:]]
    return np.logical_or.reduceat(sign, starts), np.logical_or.reduceat(sign | _FOREIGN[at], starts)


# The byte of each letter in the TCVN3 (ABC) encoding, read as Latin-1.
_TCVN3 = dict(zip("àảãáạăằẳẵắặâầẩẫấậđèẻẽéẹêềểễếệìỉĩíịòỏõóọôồổỗốộơờởỡớợùủũúụưừửữứựỳỷỹýỵĂÂÊÔƠƯĐ", "µ¶·¸¹¨»¼½¾Æ©ÇÈÉÊË®ÌÎÏÐÑªÒÓÔÕÖ×ØÜÝÞßáâãä«åæçèé¬êëìíîïñòóô\xadõö÷øùúûüýþ¡¢£¤¥¦§", strict=True))
# The letters of the VNI encoding, one or two bytes each, read as Windows-1252.
_VNI_TONES = {"": "", "́": "ù", "̀": "ø", "̉": "û", "̃": "õ", "̣": "ï"}
_VNI_HAT = {"": "â", "́": "á", "̀": "à", "̉": "å", "̃": "ã", "̣": "ä"}
_VNI_BREVE = {"": "ê", "́": "é", "̀": "è", "̉": "ú", "̃": "ü", "̣": "ë"}
_VNI_SINGLE = {"đ": "ñ", "ì": "ì", "í": "í", "ỉ": "æ", "ĩ": "ó", "ị": "ò", "ỵ": "î", "ơ": "ô", "ư": "ö"}
# The VISCII code points of the letters beyond Latin-1, from 0x80 on, then the six control codes.
_VISCII_HIGH = "ẠẮẰẶẤẦẨẬẼẸẾỀỂỄỆỐỒỔỖỘỢỚỜỞỊỎỌỈỦŨỤỲÕắằặấầẩậẽẹếềểễệốồổỗỠƠộờởịỰỨỪỬơớƯÀÁÂÃẢĂẳẵÈÉÊẺÌÍĨỳĐứÒÓÔạỷừửÙÚỹỵÝỡưàáâãảăữẫèéêẻìíĩỉđựòóôõỏọụùúũủýợỮ"


def _vni() -> dict[str, str]:
    out: dict[str, str] = {}

    def add(letter: str, code: str) -> None:
        out[code] = unicodedata.normalize("NFC", letter)
        out[code.upper()] = unicodedata.normalize("NFC", letter).upper()
        if len(code) == 2:
            out[code[0].upper() + code[1]] = unicodedata.normalize("NFC", letter).upper()

    for tone in _VNI_TONES:
        for v in "aeouy":
            if tone and not (v == "y" and tone == "̣"):
                add(v + tone, v + _VNI_TONES[tone])
        for v, w in (("â", "a"), ("ê", "e"), ("ô", "o")):
            add(v + tone, w + _VNI_HAT[tone])
        add("ă" + tone, "a" + _VNI_BREVE[tone])
        if tone:
            add("ơ" + tone, "ô" + _VNI_TONES[tone])
            add("ư" + tone, "ö" + _VNI_TONES[tone])
    for letter, code in _VNI_SINGLE.items():
        add(letter, code)
    return out


def _bytes_of(codec: str) -> dict[str, int]:
    """Byte of each character of a one-byte codec; bytes it does not define pass as control characters."""
    out = {}
    for b in range(256):
        try:
            out.setdefault(bytes([b]).decode(codec), b)
        except UnicodeDecodeError:
            pass
    for b in range(128, 256):
        out.setdefault(chr(b), b)
    return out


def _holes(codec: str) -> list[int]:
    def hole(b: int) -> bool:
        try:
            bytes([b]).decode(codec)
        except UnicodeDecodeError:
            return True
        return False

    return [b for b in range(128, 256) if hole(b)]


#: (length, true text) of all ways in which the characters of a token from some place on may be one true character.
Chunks = Callable[[str, int], list[tuple[int, str]]]
_LOST = "\ufffd"


def _utf8_as(codec: str, times: int = 1) -> Chunks:
    """UTF-8 bytes read as a one-byte codec; bytes that came out as U+FFFD are any that the codec lacks."""
    table, holes = _bytes_of(codec), [h for h in _holes(codec) or [0x81, 0x8D, 0x8F, 0x90, 0x9D] if h < 0xC0]

    def once(token: str, at: int) -> list[tuple[int, str]]:
        lead = table.get(token[at], 0)
        if not 0xC2 <= lead <= 0xF4:
            return []
        size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        rest = [holes if c == _LOST else [table[c]] if 0x80 <= table.get(c, 0) < 0xC0 else [] for c in token[at + 1 : at + size]]
        found = []
        for fill in product(*rest) if len(rest) == size - 1 else ():
            try:
                found.append((size, bytes((lead, *fill)).decode()))
            except UnicodeDecodeError:
                continue
        return found

    def again(token: str, at: int) -> list[tuple[int, str]]:
        """A true character whose bytes were garbled twice: each byte is one or more chunks of the first level."""
        paths = [(n, bytes([b])) for n, c in once(token, at) if 0xC2 <= (b := table.get(c, 0)) <= 0xF4]
        found = []
        while paths:
            longer = []
            for n, raw in paths:
                if len(raw) == (2 if raw[0] < 0xE0 else 3 if raw[0] < 0xF0 else 4):
                    try:
                        found.append((n, raw.decode()))
                    except UnicodeDecodeError:
                        pass
                elif at + n < len(token):
                    nexts = [(1, h) for h in holes] if token[at + n] == _LOST else [(m, table.get(c, 0)) for m, c in once(token, at + n)]
                    longer += [(n + m, raw + bytes([b])) for m, b in nexts if 0x80 <= b < 0xC0]
            paths = longer
        return found

    return once if times == 1 else again


def _utf8_as_wide(codec: str) -> Chunks:
    """The wrong decoding had two-byte characters; bytes it could not pair came out as U+FFFD and are lost."""

    def wide(c: str) -> bool:
        return c > "\u2e00"

    def chunks(token: str, at: int) -> list[tuple[int, str]]:
        if not wide(token[at]) or (at and wide(token[at - 1])):
            return []
        end = at
        while end < len(token) and wide(token[end]):
            end += 1
        run = token[at:end]
        if run.strip(_LOST) == "":
            return []
        try:
            raw = b"".join(b"\xff" if c == _LOST else c.encode(codec) for c in run)
        except UnicodeEncodeError:
            return []
        return [(end - at, re.sub(f"{_LOST}+", _LOST, raw.decode("utf-8", "replace")))]

    return chunks


def _capitals(token: str) -> bool:
    plain = [c for c in token if c.isascii() and c.isalpha()]
    return bool(plain) and all(c.isupper() for c in plain)


def _letters(table: dict[str, str]) -> Chunks:
    def chunks(token: str, at: int) -> list[tuple[int, str]]:
        found = [(n, table[token[at : at + n]]) for n in (2, 1) if token[at : at + n] in table and at + n <= len(token)]
        return found + [(n, x.upper()) for n, x in found if x != x.upper()] if found and _capitals(token) else found  # capitals by font

    return chunks


def _cp1258_as_1252(token: str, at: int) -> list[tuple[int, str]]:
    found = []
    for n in (1, 2):
        raw = [_BYTES_1252.get(c) for c in token[at : at + n]]
        if len(raw) == n and None not in raw and max(raw) > 127:
            try:
                out = unicodedata.normalize("NFC", bytes(raw).decode("cp1258"))
            except UnicodeDecodeError:
                continue
            if len(out) == 1:
                found.append((n, out))
    return found


_NO_SIGNS = dict.fromkeys(map(ord, "ªºµ"))
_BYTES_1252 = _bytes_of("cp1252")
_VISCII = {chr(0x80 + k): c for k, c in enumerate(_VISCII_HIGH)}

#: States besides the clean one: the name of the encoding pair and its inverse transform.
PAIRS: tuple[tuple[str, Chunks], ...] = (
    ("utf8 as cp1252", _utf8_as("cp1252")),
    ("utf8 as cp1250", _utf8_as("cp1250")),
    ("utf8 as cp1251", _utf8_as("cp1251")),
    ("utf8 as cp1258", _utf8_as("cp1258")),
    ("utf8 as mac_roman", _utf8_as("mac_roman")),
    ("utf8 as cp1252 twice", _utf8_as("cp1252", 2)),
    ("utf8 as gbk", _utf8_as_wide("gb18030")),
    ("utf8 as big5", _utf8_as_wide("big5hkscs")),
    ("tcvn3 as latin1", _letters({v: k for k, v in _TCVN3.items()})),
    ("vni as cp1252", _letters(_vni())),
    ("viscii as latin1", _letters(_VISCII)),
    ("cp1258 as cp1252", _cp1258_as_1252),
)
_NAMES = ("clean", *(n for n, _ in PAIRS), "lost")
_N = len(_NAMES)
_TWO = {k for k, n in enumerate(_NAMES) if n.startswith(("vni", "cp1258"))}  # pairs of which a character may begin with an ASCII letter


@lru_cache(maxsize=100_000)
def _states_from(c: str) -> tuple[int, ...]:
    """The pairs of which a chunk may begin with a character."""
    return tuple(k for k, first in enumerate(_FIRST, 1) if first(c))


def _lead(codec: str) -> Callable[[str], bool]:
    table = _bytes_of(codec)
    return lambda c: 0xC2 <= table.get(c, 0) <= 0xF4


#: By pair, whether a chunk may begin with a character.
_FIRST: tuple[Callable[[str], bool], ...] = (
    *(_lead(c) for c in ("cp1252", "cp1250", "cp1251", "cp1258", "mac_roman", "cp1252")),
    *[lambda c: c > "\u2e00"] * 2,
    *(frozenset(x[0] for x in table).__contains__ for table in (_TCVN3.values(), _vni(), _VISCII)),
    _BYTES_1252.__contains__,
)
#: Prior probabilities of the changes of state, as logs: into a pair of UTF-8, into a pair whose inverse accepts nearly
#: any text (one odd word is no evidence), back to clean, from one pair to another.
_ENTER, _ENTER_LETTERS, _LEAVE, _SWAP = -9.0, -20.0, -4.0, -12.0
_PRIOR = 20_000.0  # tokens that the prior counts for when transitions are trained
_UNSEEN = -15.0  # of a character outside the model's symbols, in the clean state
SLACK = 3.0  # that the first reading of a token's characters may be less likely than the best one
_LOST_SCORE = -3.0  # of a lost character in its state
_FOREIGN_LETTER = 4.0  # by which a letter outside the model's symbols is likelier than a stray sign inside a word
_KEPT = 100_000  # characters, times states, of which the paths are kept to trace them


def _foreign(c: str) -> bool:
    return unicodedata.category(c)[0] == "L" and c not in "ªºƒ"


def prior() -> np.ndarray:
    """Log-probabilities of the changes of state; row: from, column: to. Staying costs nothing."""
    change = np.full((_N, _N), _SWAP)
    change[:, 0] = _LEAVE
    change[0, :] = [0.0, *(_ENTER if n.startswith("utf8") else _ENTER_LETTERS for n, _ in PAIRS), _ENTER]
    np.fill_diagonal(change, 0.0)
    return change


def trained(counts: np.ndarray) -> np.ndarray:
    """Changes of state from counts (from, to) over tokens, the prior counting as ``_PRIOR`` tokens of each state."""
    base = np.exp(prior())
    np.fill_diagonal(base, 0.0)
    seen = counts.astype(float).copy()
    total = seen.sum(1, keepdims=True) + _PRIOR
    np.fill_diagonal(seen, 0.0)
    with np.errstate(divide="ignore"):
        change = np.log((seen + _PRIOR * base) / total)
    np.fill_diagonal(change, 0.0)
    change = np.maximum(change, prior() - 3.0)  # texts without a pair do not rule it out
    letters = [k for k, n in enumerate(_NAMES) if k and k < _N - 1 and not n.startswith("utf8")]
    change[:, letters] = np.minimum(change[:, letters], prior()[:, letters])  # nor do many texts make one odd word evidence
    return change


def _open() -> list[float]:
    """By state, the most that the log-probability of entering it from the clean one can come to by training."""
    free = np.zeros(_N)
    letters = [k for k, n in enumerate(_NAMES) if k and k < _N - 1 and not n.startswith("utf8")]
    free[letters] = prior()[0, letters]
    return free.tolist()


def count_bigrams(df: DataFrame, text_col: str) -> np.ndarray:
    """K x K counts of neighbouring symbols in all texts that hold no sign of a wrong decoding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_K * _K, np.int64)
        for b in batches:
            for texts in _pieces(b["t"]):
                at, starts = _classes(texts)
                counted = ~doubtful(at, starts)[0]
                own = np.repeat(counted, np.diff(np.append(starts, len(at))))
                total += np.bincount((at[:-1] * _K + at[1:])[own[:-1]], minlength=_K * _K)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"pair": seen, "n": total[seen]})

    plain = df.select(F.col(text_col).alias("t")).where(F.length("t") > 0)
    out = np.zeros(_K * _K)
    for r in plain.mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(_K, _K)


class Model:
    """Labels the characters of texts."""

    def __init__(self, bigrams: np.ndarray, change: np.ndarray | None = None):
        first = bigrams.sum(1, keepdims=True)
        alone = (bigrams.sum(0) + 0.5) / (bigrams.sum() + 0.5 * _K)
        smooth = (bigrams + 20 * alone) / (first + 20)
        smooth = 0.999 * smooth + 1e-5  # a pair of known symbols is never as unlikely as an unknown one
        smooth[:, _OTHER] = math.exp(_UNSEEN)
        self.log = np.log(smooth).tolist()
        self.change = prior() if change is None else change
        self.steps = self.change.tolist()
        self.into = self.change.T.tolist()
        self.open = _open()
        self.known: dict[tuple[str, tuple[int, ...]], tuple[tuple[int, ...], list[list[float]]]] = {}
        self.tables: dict[tuple[int, ...], dict[str, tuple[tuple[int, ...], list[list[float]]] | None]] = {}  # by hopeful states
        self.n_tables = 0
        self.tracing = True
        self.cells: dict[tuple[str, tuple[int, ...], int], list[dict[tuple[int, int], tuple]]] = {}  # of the text at hand
        self.n_cells = 0
        self.traces: dict[tuple[str, tuple[int, ...], int, int], list[tuple[int, int, int, str]]] = {}
        self.chunks: dict[str, dict[int, dict[int, list[tuple[int, str]]]]] = {}
        self.hopes: dict[str, tuple[tuple[int, float], ...]] = {}
        self.plain: set[str] = set()

    def with_change(self, change: np.ndarray) -> Model:
        """The same clean model under other transitions; what does not depend on them is not worked out again."""
        other = copy(self)
        other.change, other.steps, other.into = change, change.tolist(), change.T.tolist()
        other.known, other.tables, other.n_tables, other.cells, other.n_cells, other.traces = {}, {}, 0, {}, 0, {}
        return other

    def _emit(self, before: int, text: str) -> tuple[float, int]:
        """Log-probability of true characters after a symbol, and the last symbol."""
        total = 0.0
        for c in text:
            k = _INDEX.get(c, _OTHER)
            total += self.log[before][k]
            if k == _OTHER and _foreign(c):
                total += _FOREIGN_LETTER
            before = k
        return total, before

    def hope(self, token: str) -> tuple[tuple[int, float], ...]:
        """States that can explain a token, or stretches of it, and how much better than the clean one at most, about."""
        found = [(_N - 1, 20.0 * token.count(_LOST))] if _LOST in token else []
        signs = not any(map(str.isalpha, token.translate(_NO_SIGNS)))
        capitals = _capitals(token)
        for state, own in self.options(token).items():
            if state == _N - 1:
                continue
            utf8 = _NAMES[state].startswith("utf8")
            if signs and not utf8:
                found.append((state, 0.0))  # a sign that stands alone is no evidence
                continue
            # Stretches that the pair can emit: what stands there, and the true text.
            at, parts = 0, [["", ""]]
            while at < len(token):
                c = token[at]
                if at in own:
                    n, x = own[at][0]
                elif c <= "\x7f" or not (utf8 or c.isalpha()):
                    n, x = 1, c
                else:
                    parts.append(["", ""])
                    at += 1
                    continue
                parts[-1][0] += token[at : at + n]
                parts[-1][1] += x
                at += n
            gain = 0.0
            for was, true in parts:
                if was != true:
                    best = max(self._whole(x) for x in ({true, true.upper()} if capitals else {true})) - self._whole(was)
                    gain += best if len(parts) == 1 and not utf8 else max(0.0, best + SLACK)
            found.append((state, gain))
        return tuple(found)

    def options(self, token: str) -> dict[int, dict[int, list[tuple[int, str]]]]:
        """By state: by place, the chunks of the states that can explain some of the token."""
        found = self.chunks.get(token)
        if found is None:
            if len(self.chunks) > 100_000:
                self.chunks.clear()
            found = self.chunks[token] = {}
            odd = [k for k, c in enumerate(token) if c > "\x7f"]
            near = sorted({j for k in odd for j in (k - 1, k) if j >= 0})
            for state in sorted(set().union(*(_states_from(token[k]) for k in near))):
                own = {k: c for k in (near if state in _TWO else odd) if (c := PAIRS[state - 1][1](token, k))}
                if own:
                    found[state] = own
            if _LOST in token:
                found[_N - 1] = {k: [(1, _LOST)] for k in odd if token[k] == _LOST}
        return found

    def _whole(self, token: str) -> float:
        score, last = self._emit(0, token)
        return score + self.log[last][0]

    def _moves(self, token: str, options: dict[int, dict[int, list[tuple[int, str]]]]) -> list[list[tuple]]:
        """By place, what each state can emit there: (state, length, true text, its state and symbol, extra score).

        The state and symbol are None where the true text is not one character.
        """
        out = []
        for at, c in enumerate(token):
            plain, letter = c <= "\x7f", c.isalpha()
            symbol = _INDEX.get(c, _OTHER)
            extra = _FOREIGN_LETTER if symbol == _OTHER and _foreign(c) else 0.0
            here = [(0, 1, c, (0, symbol), extra)]
            for state, own in options.items():
                if state != _N - 1 and (plain or (not letter and at not in own)):
                    here.append((state, 1, c, (state, symbol), extra))
                for n, x in own.get(at, ()):
                    if len(x) != 1:
                        here.append((state, n, x, None, 0.0))
                        continue
                    to = _INDEX.get(x, _OTHER)
                    here.append((state, n, x, (state, to), _FOREIGN_LETTER if to == _OTHER and _foreign(x) else 0.0))
            out.append(here)
        return out

    def _paths(self, moves: list[list[tuple]], start: int) -> list[dict[tuple[int, int], tuple]]:
        """Viterbi over the characters of a token from a state: by place, by state and last true symbol, the best
        (score, place before, key before, true text)."""
        steps, log = self.steps, self.log
        cells: list[dict[tuple[int, int], tuple]] = [{} for _ in range(len(moves) + 1)]
        cells[0][start, 0] = (0.0, -1, None, "")
        for at, own in enumerate(moves):
            here = [(key, v[0], steps[key[0]], log[key[1]]) for key, v in cells[at].items()]
            if not here:
                continue
            for state, n, x, to, extra in own:
                after = cells[at + n]
                if to is None:
                    for key, before, step, _ in here:
                        gain, last = self._emit(key[1], x)
                        score = before + step[state] + gain
                        old = after.get((state, last))
                        if old is None or score > old[0]:
                            after[state, last] = (score, at, key, x)
                    continue
                best, came, symbol = -math.inf, None, to[1]
                if state == _N - 1:
                    for key, before, step, _ in here:
                        score = before + step[state] + _LOST_SCORE
                        if score > best:
                            best, came = score, key
                else:
                    for key, before, step, symbols in here:
                        score = before + step[state] + (symbols[symbol] + extra)
                        if score > best:
                            best, came = score, key
                old = after.get(to)
                if old is None or best > old[0]:
                    after[to] = (best, at, came, x)
        return cells

    def look_up(self, token: str, hopeful: tuple[int, ...]) -> tuple[tuple[int, ...], list[list[float]]] | None:
        """The states that matter in a token and the scores (to, from) of its best paths, relative to the clean one.

        None where of the clean and the hopeful states only the clean one can emit the token.
        """
        found = self.options(token)
        able = tuple(s for s in hopeful if s in found)
        if not able:
            return None
        key = (token, able)
        if key not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[key] = self._summary(token, {s: found[s] for s in able})
        return self.known[key]

    def _summary(self, token: str, options: dict[int, dict[int, list[tuple[int, str]]]]) -> tuple[tuple[int, ...], list[list[float]]]:
        base = self._whole(token)
        states = (0, *options)
        place = {s: k for k, s in enumerate(states)}
        out = [[-math.inf] * len(states) for _ in states]
        moves = self._moves(token, options)
        kept = self.tracing and self.n_cells < _KEPT and len(token) * len(states) ** 2 < _KEPT
        for i, start in enumerate(states):
            cells = self._paths(moves, start)
            if kept:
                self.cells[token, states, start] = cells
                self.n_cells += len(token) * len(states)
            for (state, symbol), v in cells[-1].items():
                own = out[place[state]]
                own[i] = max(own[i], v[0] + self.log[symbol][0] - base)
        if not any(map(str.isalpha, token.translate(_NO_SIGNS))):  # a sign that stands alone is no evidence, but for UTF-8
            odd = [bool(s) and s < _N - 1 and not _NAMES[s].startswith("utf8") for s in states]
            out = [[min(v, 0.0) if a or b else v for b, v in zip(odd, own, strict=True)] for a, own in zip(odd, out, strict=True)]
        return states, out

    def hopeful(self, words: set[str]) -> dict[str, tuple[tuple[int, float], ...]]:
        """What ``hope`` gives for those of the words for which it gives any."""
        out = {}
        for token in words - self.plain:
            own = self.hopes.get(token)
            if own is None:
                own = () if token.isascii() else self.hope(token)
                if len(self.plain) + len(self.hopes) > 300_000:
                    self.plain.clear()
                    self.hopes.clear()
                if own:
                    self.hopes[token] = own
                elif len(token) <= 64:
                    self.plain.add(token)
            if own:
                out[token] = own
        return out

    def gains(self, words: list[str], hopes: dict[str, tuple[tuple[int, float], ...]]) -> dict[int, float]:
        """How much better a state explains the best run of words that it can emit than the clean one, at most, if at all."""
        gains: dict[int, float] = {}
        runs: dict[int, float] = {}
        for token in words:
            own = hopes.get(token)
            if own:
                before, runs = runs, {}
                for k, g in own:
                    if k in before and before[k] > 0.0:
                        g += before[k]
                    runs[k] = g
                    if g > 0.0 and g > gains.get(k, 0.0):
                        gains[k] = g
            elif runs and not token.isascii():
                runs = {}
        return gains

    def label(self, text: str, tracing: bool = True) -> list[tuple[int, int, int, str]]:
        """Spans (start, end, state, true text) of the characters that are not clean, in order.

        Without ``tracing`` only those of one token, if any. ``suspect`` tells afterwards whether there might be any
        under other transitions, and ``changes``, if there are spans, how often a state followed another.
        """
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        hopes = self.hopeful(set(words))
        gains = self.gains(words, hopes) if hopes else {}
        self.suspect = any(g + self.open[k] > 0 for k, g in gains.items())
        # A state that gains less than it costs to enter is on no best path, nor one that another explains every token
        # of the text at least as well as.
        able = sorted((k for k, g in gains.items() if g + self.steps[0][k] > 0), key=lambda k: (-gains[k], k))
        if not able:
            return []
        if len(able) > 1:
            by_token = [dict(g) for g in hopes.values()]
            kept: list[int] = []
            for k in able:
                if not any(self.steps[0][j] >= self.steps[0][k] - 5.0 and all(g.get(j, -math.inf) >= g[k] - 1e-9 for g in by_token if k in g) for j in kept):
                    kept.append(k)
            able = kept
        states_here = tuple(sorted(able))
        if self.n_tables > 300_000:
            self.tables.clear()
            self.n_tables = 0
        table = self.tables.setdefault(states_here, {})
        self.tracing, self.n_cells = tracing, 0
        self.cells.clear()
        found = [(m.start(), m.group()) for m in _TOKEN.finditer(text)]
        into = self.into
        best: list[tuple[int, float]] = [(0, 0.0)]
        back = []
        for _, token in found:
            if token in table:
                known = table[token]
            else:
                known = table[token] = self.look_up(token, states_here)
                self.n_tables += 1
            if known is None:
                if len(best) == 1 and best[0][0] == 0:
                    back.append((0, None, None))
                    continue
                top, came = -math.inf, 0
                for k, v in best:
                    v += into[0][k]
                    if v > top:
                        top, came = v, k
                best = [(0, top)]
                back.append((came, None, None))
                continue
            states, out = known
            if len(states) == 2 and len(best) == 2:  # as below, for the case that is by far the most frequent
                (k0, v0), (k1, v1) = best
                step = into[0]
                a, b = v0 + step[k0], v1 + step[k1]
                came0, in0 = (k1, b) if b > a else (k0, a)
                step = into[states[1]]
                a, b = v0 + step[k0], v1 + step[k1]
                came1, in1 = (k1, b) if b > a else (k0, a)
                best, pick = [], {}
                for to, gain in zip(states, out, strict=True):
                    a, b = in0 + gain[0], in1 + gain[1]
                    at, top = (1, b) if b > a else (0, a)
                    if top > -math.inf:
                        best.append((to, top))
                        pick[to] = at
                back.append(((came0, came1), states, pick))
                continue
            came, entered = [], []
            for to in states:
                top, at, step = -math.inf, 0, into[to]
                for k, v in best:
                    v += step[k]
                    if v > top:
                        top, at = v, k
                came.append(at)
                entered.append(top)
            best, pick = [], {}
            for to, gain in zip(states, out, strict=True):
                top, at, i = -math.inf, 0, 0
                for v in entered:
                    v += gain[i]
                    if v > top:
                        top, at = v, i
                    i += 1
                if top > -math.inf:
                    best.append((to, top))
                    pick[to] = at
            back.append((came, states, pick))
        state, spans = max(best, key=lambda b: b[1])[0], []
        changes = []
        for (begin, token), (came, states, pick) in zip(reversed(found), reversed(back), strict=True):
            if states is None:
                changes.append((came, 0))
                state = came
                continue
            i = pick[state]
            start = states[i]
            if tracing or not spans:
                key = (token, states, start, state)
                trace = self.traces.get(key)
                if trace is None:
                    if len(self.traces) > 300_000:
                        self.traces.clear()
                    trace = self.traces[key] = self._trace(token, states, start, state)
                if trace:
                    spans.append([(begin + a, begin + e, s, x) for a, e, s, x in trace])
            changes.append((came[i], start))
            state = came[i]
        self.changes = Counter(changes)
        return [x for part in reversed(spans) for x in part]

    def _trace(self, token: str, states: tuple[int, ...], start: int, end: int) -> list[tuple[int, int, int, str]]:
        """Stretches (start, end, state, true text) of one state other than clean on the best path through a token."""
        cells = self.cells.get((token, states, start))
        if cells is None:
            options = self.options(token)
            cells = self._paths(self._moves(token, {s: options[s] for s in states if s}), start)
        at, out = len(token), []
        key = max((k for k in cells[at] if k[0] == end), key=lambda k: cells[at][k][0] + self.log[k[1]][0])
        while at > 0:
            _, before, came, x = cells[at][key]
            state = key[0]
            if state:
                if out and out[-1][0] == at and out[-1][2] == state:
                    _, e, _, y = out.pop()
                    out.append((before, e, state, x + y))
                else:
                    out.append((before, at, state, x))
            at, key = before, came
        return [t for t in reversed(out) if t[3] != token[t[0] : t[1]] or t[2] == _N - 1]


_model: list[tuple[bytes, Model]] = []  # with its bigram counts


def shared_model(bigrams: np.ndarray, change: np.ndarray) -> Model:
    """The model of this Python worker: what it worked out for the tokens of one task serves the next."""
    clean = bigrams.tobytes()
    if not _model or _model[0][0] != clean:
        _model[:] = [(clean, Model(bigrams, change))]
    elif (_model[0][1].change != change).any():
        _model[:] = [(clean, _model[0][1].with_change(change))]
    return _model[0][1]


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Without the search for cycles of objects: a model makes very many objects and none of them in cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_TOKEN = re.compile(r"[^ \t\r\n]*[^\x00-\x7f \t\r\n][^ \t\r\n]*")
_BLANKS = re.compile(r"[ \t\r\n]+")


def train(df: DataFrame, id_col: str, text_col: str, bigrams: np.ndarray) -> tuple[np.ndarray, DataFrame]:
    """Changes of state from the labels that the prior gives to all texts, and (id, t) of the texts that may be garbled."""
    shared = df.sparkSession.sparkContext.broadcast(bigrams)
    names = ["id", "t", "a", "b", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared_model(shared.value, prior())
        counts = np.zeros((_N, _N))
        for b in batches:
            kept = []
            with _no_cycles():
                for text in b["t"]:
                    if model.label(text, tracing=False):
                        for (a, b_), n in model.changes.items():
                            counts[a, b_] += n
                    else:
                        counts[0, 0] += text.count(" ") + 1
                    kept.append(model.suspect)
            yield b[np.array(kept, bool)].assign(a=None, b=None, n=None)[names]
        rows, columns = np.nonzero(counts)
        yield pd.DataFrame({"id": None, "t": None, "a": rows, "b": columns, "n": counts[rows, columns]})[names]

    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    out = stored(texts.mapInPandas(run, f"id {kind}, t string, a int, b int, n double"))
    counts = np.zeros((_N, _N))
    for r in out.where("n is not null").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # whole numbers: any order gives the same sum
        counts[r["a"], r["b"]] = r["n"]
    return trained(counts), out.where("t is not null").select("id", "t")


def find_garbled(df: DataFrame, id_col: str, text_col: str, bigrams: np.ndarray | None = None) -> DataFrame:
    """(id, states, n_tokens, restored): the garbled texts, the encoding pairs found and the text as far as restored.

    ``n_tokens`` counts the words that hold a labelled span.
    """
    if bigrams is None:
        bigrams = count_bigrams(df, text_col)
    change, texts = train(df, id_col, text_col, bigrams)
    shared = df.sparkSession.sparkContext.broadcast((bigrams, change))  # K * K numbers and fewer

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared_model(*shared.value)
        for b in batches:
            out = []
            for rid, text in zip(b["id"], b["t"], strict=True):
                with _no_cycles():
                    spans = model.label(text)
                if spans:
                    parts, at, words, end = [], 0, 0, -1
                    for a, e, _, x in spans:
                        words += end < 0 or _BLANKS.search(text, end, a) is not None
                        parts += (text[at:a], x)
                        at = end = e
                    out.append((rid, sorted({_NAMES[s] for _, _, s, _ in spans}), words, "".join(parts) + text[at:]))
            yield pd.DataFrame(out, columns=["id", "states", "n_tokens", "restored"])

    kind = df.schema[id_col].dataType.simpleString()
    return texts.mapInPandas(run, f"id {kind}, states array<string>, n_tokens int, restored string")
