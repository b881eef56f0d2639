"""Language identification of words, spans and documents.

Learning: character trigrams of words (their ends count as characters) are counted by language
over all labelled documents, hashed into ``BINS`` bins, beside the letters of each script. The
model is one number per bin and language.

Prediction: a text's words are runs of letters and marks. A word's script, from public block
ranges, narrows the languages to those that write it; its score for each of them is the sum of
its trigrams' log probabilities. Viterbi over the words of a text, with a penalty for every
change of language, labels the words, and runs of equal labels are the spans. The document's
language is the one with most letters; its score is that language's share of the letters.

All steps work on arrays of the characters of many texts; the Viterbi steps go through the
words of a block's texts side by side.

Defined results: a null text or one without letters is ``und`` with score 0 and no spans; a
word in a script that no learned language writes is open to all of them; equal scores go to the
language that sorts first; without labelled texts all are ``und``; rows with a null label are
not learned from; repeated rows get the same result each; input columns named like the added
one are replaced, all others stay; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import boxed, unboxed

#: Fixed values (public character block ranges): first and last code point of the scripts.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
BINS = 1 << 15
#: A language writes a script that has this share of its letters.
WRITES = 0.001
#: What a change of language costs, in units of the natural logarithm.
SWITCH = 8.0
BLOCK_CHARS = 4 << 20
SPANS = "array<struct<start:int,length:int,lang:string>>"


class Letters:
    """Tables over code points: word character, letter, lower case, script (0 for none of the listed)."""

    def __init__(self):
        self._grow(0x3000)

    def _grow(self, size: int) -> None:
        import unicodedata

        import numpy as np

        kinds = [unicodedata.category(chr(c))[0] for c in range(size)]
        self.letter = np.array([k == "L" for k in kinds])
        self.word = self.letter | np.array([k == "M" for k in kinds])
        self.lower = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(size)], "u4")
        self.script = np.zeros(size, "u1")
        for i, ranges in enumerate(SCRIPTS.values(), 1):
            for lo, hi in ranges:
                self.script[lo:hi + 1] = i

    def words(self, texts: list[str]) -> Words:
        import numpy as np

        lengths = np.array([len(t) + 1 for t in texts], "i8")
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "u4")
        if len(points) and (top := int(points.max())) >= len(self.word):
            self._grow(0x110000 if top > 0xFFFF else 0x10000)
        return Words(self, points, np.cumsum(lengths) - lengths)


class Words:
    """The words of a block of texts: ``first`` and ``length`` in the joined characters, ``text`` they belong
    to, ``script``; and ``codes``, the trigram bins of their characters in one row, word by word."""

    def __init__(self, table: Letters, points, begins):
        import numpy as np

        inside = table.word[points]
        edge = np.flatnonzero(np.diff(inside, prepend=False))  # the last character is a line feed, so words end
        first, end = edge[::2], edge[1::2]
        letter = table.letter[points]
        has = np.add.reduceat(letter, first, dtype="i8") > 0 if len(first) else np.zeros(0, bool)
        if not has.all():  # marks alone are no word
            for a, b in zip(first[~has], end[~has], strict=True):
                inside[a:b] = False
            first, end = first[has], end[has]
        low = np.where(inside, table.lower[points], 0).astype("u8")
        at = np.flatnonzero(inside)
        before = np.where(at > 0, low[at - 1], 0)
        mixed = before * 73856093 + low[at] * 19349663 + low[at + 1] * 83492791
        self.codes = ((mixed ^ (mixed >> np.uint64(17))) % BINS).astype("i4")
        self.first, self.length = first, end - first
        self.text = np.searchsorted(begins, first, "right") - 1
        self.script = table.script[points[first]]
        self.begins = begins
        self.offsets = np.cumsum(self.length) - self.length


def text_blocks(batches, column: int = 0):
    """Lists of row numbers and texts of one Arrow batch each, of bounded size; longest texts first."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
        rows, size = [], 0
        parts = []
        for i in order:
            rows.append(i)
            size += len(texts[i] or "")
            if size >= BLOCK_CHARS:
                parts.append(rows)
                rows, size = [], 0
        if rows:
            parts.append(rows)
        yield batch, [(rows, [texts[i] or "" for i in rows]) for rows in parts]


@dataclass
class Model:
    languages: list[str]
    table: object  # float32 (BINS, languages): log probabilities
    writes: object  # bool (scripts + 1, languages): open to a word of the script


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learns from every row with a label. Tasks hold counts per language, and what reaches the driver is
    one number per language and bin that occurs."""
    def count(batches):
        import numpy as np
        import pyarrow as pa

        letters, held, bins = Letters(), {}, BINS + len(SCRIPTS) + 1

        def flush():
            for name, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype("i4")), pa.array(n[at])], ["lang", "bin", "n"])
            held.clear()

        for batch, blocks in text_blocks(batches):
            names = batch.column(1).to_pylist()
            for rows, texts in blocks:
                words = letters.words(texts)
                own = {name: i for i, name in enumerate(sorted({names[i] for i in rows}))}
                of = np.array([own[names[i]] for i in rows], "i8")[words.text]
                grams = np.repeat(of, words.length) * bins + words.codes
                scripts = np.repeat(of * bins + BINS + words.script, words.length)
                n = np.bincount(np.concatenate((grams, scripts)), minlength=len(own) * bins).reshape(len(own), bins)
                for name, i in own.items():
                    held[name] = held[name] + n[i] if name in held else n[i]
                if len(held) > 100:
                    yield from flush()
        yield from flush()

    labelled = docs.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{text}`").cast("string"), F.col(f"`{lang}`").cast("string"))
    counts = labelled.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    return _model(counts.toPandas())


def _model(counts) -> Model:
    import numpy as np

    languages = sorted(set(counts["lang"]))
    if not languages:
        return Model([], np.zeros((BINS, 0), "f4"), np.zeros((len(SCRIPTS) + 1, 0), bool))
    n = np.zeros((len(languages), BINS + len(SCRIPTS) + 1))
    n[[languages.index(x) for x in counts["lang"]], counts["bin"]] = counts["n"]
    grams, scripts = n[:, :BINS], n[:, BINS:]
    rate = (grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BINS)
    writes = (scripts >= WRITES * scripts.sum(1, keepdims=True)) & (scripts > 0)
    writes[:, ~writes.any(0)] = True
    return Model(languages, np.ascontiguousarray(np.log(rate).T, "f4"), writes.T)


def word_scores(words: Words, model: Model):
    """Log probability of every word for every language; minus infinity where its script rules it out."""
    import numpy as np

    if not len(words.first):
        return np.zeros((0, len(model.languages)), "f4")
    by_char = model.table[words.codes]
    out = np.add.reduceat(by_char, words.offsets, axis=0)
    out -= out.max(axis=1, keepdims=True)
    return np.where(model.writes[words.script], out, np.float32(-np.inf))


def label_words(scores, counts, switch: float):
    """Viterbi labels; texts are ordered by falling number of words, so those with a word at a step come first."""
    import numpy as np

    counts = np.asarray(counts, "i8")
    begins = np.cumsum(counts) - counts
    steps = int(counts.max(initial=0))
    live = np.searchsorted(-counts, -np.arange(1, steps + 2), "right")
    stay, come_from = np.ones(scores.shape, bool), np.zeros(len(scores), "u2")
    label = np.zeros(len(scores), "u2")
    last = np.zeros(len(counts), "i8")
    value = None
    for t in range(steps):
        n = live[t]
        at = begins[:n] + t
        if t == 0:
            value = scores[at].astype("f8")
        else:
            value = value[:n]
            top = value.argmax(1)
            moved = np.take_along_axis(value, top[:, None], 1) - switch
            kept = value >= moved
            stay[at], come_from[at] = kept, top
            value = np.where(kept, value, moved) + scores[at]
        value = value - value.max(1, keepdims=True)
        if live[t + 1] < n:
            last[live[t + 1]:n] = value[live[t + 1]:].argmax(1)
    now = np.zeros(0, "i8")
    for t in range(steps - 1, -1, -1):
        n = live[t]
        now = np.concatenate((now, last[len(now):n]))
        at = begins[:n] + t
        label[at] = now
        if t:
            now = np.where(stay[at, now], now, come_from[at])
    return label


def identify(docs: DataFrame, model: Model, text: str = "text", result: str = "language", switch: float = SWITCH) -> DataFrame:
    """``docs`` plus the struct ``result``: ``lang``, ``score`` and ``spans`` (start and length in code points)."""
    def predict(batches):
        import numpy as np
        import pyarrow as pa

        letters, names = Letters(), model.languages
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string())])))])
        for batch, blocks in text_blocks(batches):
            out = [{"lang": "und", "score": 0.0, "spans": []}] * batch.num_rows
            for rows, texts in blocks if names else ():
                words = letters.words(texts)
                if not len(words.first):
                    continue
                scores = word_scores(words, model)
                counts = np.bincount(words.text, minlength=len(texts))
                order = np.argsort(-counts, kind="stable")  # the words again, text by text in this order
                begins = np.cumsum(counts) - counts
                place = np.repeat(begins[order], counts[order]) + np.arange(len(scores)) - np.repeat(np.cumsum(counts[order]) - counts[order], counts[order])
                label = np.empty(len(scores), "i8")
                label[place] = label_words(scores[place], counts[order], switch)
                held = np.bincount(words.text * len(names) + label, words.length, len(texts) * len(names)).reshape(len(texts), -1)
                best, total = held.argmax(1), held.sum(1)
                run = np.flatnonzero((np.diff(words.text, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
                until = np.append(run[1:], len(label)) - 1
                start = words.first[run] - words.begins[words.text[run]]
                length = words.first[until] + words.length[until] - words.first[run]
                spans = [[] for _ in texts]
                for i, s, n, x in zip(words.text[run].tolist(), start.tolist(), length.tolist(), label[run].tolist(), strict=True):
                    spans[i].append({"start": s, "length": n, "lang": names[x]})
                for j, i in enumerate(rows):
                    if total[j]:
                        out[i] = {"lang": names[best[j]], "score": held[j, best[j]] / total[j], "spans": spans[j]}
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, kind)], [*batch.schema.names[1:], result])

    rows = boxed(docs)
    given = rows.select(F.col(f"row_in.`{text}`").cast("string").alias("text_in"), "row_in")
    schema = f"row_in {rows.schema['row_in'].dataType.simpleString()}, `{result}` struct<lang:string,score:double,spans:{SPANS}>"
    return unboxed(given.mapInArrow(predict, schema), [result])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 by 4. Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
