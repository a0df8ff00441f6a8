"""Language identification by spans: script ranges narrow the candidates, Viterbi labels the words.

Learned per language: log frequencies of letter trigrams (bytes of small-letter words, blanks at their ends), and the
scripts that its texts use. A word's script is that of its first letter; languages never seen in that script are no
candidates for it. Viterbi over the words of a text, with a fixed penalty for a change of language, gives each word a
label; neighbouring words of one label are a span. Texts of a slice run side by side, and so do the runs of ``RUN`` words
that a longer text is cut into: each run is walked from every language it may be entered with, and the runs are then
chained, so that the labels are those of one walk over the whole text, in the time of as many short ones.

Training reads the labelled texts of at most ``TRAIN_ROWS`` ids (a documented bound; the smallest id hashes), counted
partition by partition into one table per language. Nulls: a null text is ``und`` with score 0, as is one without a
letter; null languages are not learned from. Repeated rows are labelled one by one. Ties go to the language that sorts
first. With nothing to learn from, every text is ``und``. Texts may have any length, and languages any number: from 257 on
they share trigram classes (hashes of fewer bits), so that the table that travels to the tasks stays within
``TABLE_BYTES``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, cut, extend, lower, sample_of, steps, table, word_bounds

#: Ids, at most, whose rows the model learns from.
TRAIN_ROWS = 4000
BITS = 16
#: Cost of a change of language between two words, in nats.
SWITCH = 12.0
SMOOTH = 0.5
#: A script counts as a language's own from this share of its words on.
SCRIPT_SHARE = 0.005
GROUP_BYTES = 6 << 20
#: Words of a run, and the number of languages up to which a run is walked from each of them. Beyond it a step does the
#: work of so many languages that texts are walked whole.
RUN, ENTRIES = 512, 32
#: Bytes of the table of log frequencies, at most (32-bit numbers, languages times trigram classes).
TABLE_BYTES = 64 << 20

#: First code points of script ranges (Unicode blocks), and the script that begins there.
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "indic", "thai", "georgian", "hangul", "kana", "han", "other")
RANGES = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"))
_EDGES = np.array([r[0] for r in RANGES])
_OWNER = np.array([SCRIPTS.index(r[1]) for r in RANGES])

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


def _words(data: np.ndarray, at: np.ndarray):
    """Bounds of the words, row starts, trigram of every byte (0 where it is no letter), and each word's script (-1: no letter)."""
    starts, ends, first = word_bounds(data, at)
    small = lower(data)
    letter = _LETTER[small]
    small = np.where(letter, small, 32).astype(np.uint32)
    before, after = np.full(data.size, 32, np.uint32), np.full(data.size, 32, np.uint32)
    before[1:], after[:-1] = small[:-1], small[1:]
    edge = at[(at > 0) & (at < data.size)]
    before[edge], after[edge - 1] = 32, 32
    gram = ((before << 16 | small << 8 | after) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    hits = np.flatnonzero(letter)
    script = np.full(starts.size, -1)
    if starts.size and hits.size:
        lead = np.searchsorted(hits, starts)
        at_letter = hits[np.minimum(lead, hits.size - 1)]
        has = (lead < hits.size) & (at_letter < ends) & (at_letter >= starts)
        b = [data[np.minimum(at_letter + k, data.size - 1)].astype(np.int64) for k in range(3)]
        point = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63))
        point = np.where(b[0] >= 0xF0, 0x1F00 + 0x100, point)  # beyond the basic plane: other
        script = np.where(has, _OWNER[np.searchsorted(_EDGES, point, "right") - 1], -1)
    return starts, ends, first, np.where(letter, gram, 0), letter, script


def _count(batches):
    """Trigram and script counts per language; tables of many languages are passed on before they are many more."""
    grams: dict[str, np.ndarray] = {}

    def out():
        for lang, g in grams.items():
            i = np.flatnonzero(g)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * i.size), pa.array(i), pa.array(g[i])], names=["lang", "i", "n"])
        grams.clear()

    for batch in batches:
        if len(grams) > 64:
            yield from out()
        for part, data, at in steps(batch, "text"):
            starts, ends, first, gram, letter, script = _words(data, at)
            for k, lang in enumerate(part.column("lang").to_pylist()):
                lo, hi = at[k], at[k + 1]
                g = grams.setdefault(lang, np.zeros((1 << BITS) + len(SCRIPTS), np.int64))
                g[: 1 << BITS] += np.bincount(gram[lo:hi][letter[lo:hi]], minlength=1 << BITS)
                s = script[first[k] : first[k + 1]]
                g[1 << BITS :] += np.bincount(s[s >= 0], minlength=len(SCRIPTS))
    yield from out()


def bits_for(langs: int) -> int:
    """Bits of a trigram class, with which the table of so many languages has ``TABLE_BYTES`` at most."""
    return max(1, min(BITS, (TABLE_BYTES // 4 // max(1, langs)).bit_length() - 1))


class Model:
    """What is known of the languages ``langs`` (sorted): ``grams`` and ``scripts`` count what each has, a row for each."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.langs, self.bits = langs, grams.shape[1].bit_length() - 1
        logs = np.log(grams + np.float32(SMOOTH), dtype=np.float32)
        logs -= np.log(grams.sum(1, dtype=np.float64) + SMOOTH * grams.shape[1]).astype(np.float32)[:, None]
        logs -= logs.mean(0, keepdims=True) if langs else 0
        self.table = logs.T.copy()
        own = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
        own |= ~own.any(0, keepdims=True)  # a script that no language uses rules none out
        self.allowed = own.T


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_ROWS) -> Model:
    """A model of the rows that have a language (at most ``most`` of them)."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = cut(sample_of(known.select(F.col(id_col).alias("id")).distinct(), "id", most))
    rows = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(chosen), "id")  # at most `most` rows
    counted = cut(rows.select("lang", "text").mapInArrow(_count, "lang string, i long, n long").groupBy("lang", "i").agg(F.sum("n").alias("n")))
    bits = bits_for(counted.select("lang").distinct().count())
    if bits < BITS:  # before they are sent to the driver
        gram = F.col("i") < 1 << BITS
        folded = F.when(gram, F.shiftright("i", BITS - bits)).otherwise(F.col("i"))
        counted = counted.groupBy("lang", folded.alias("i")).agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # TABLE_BYTES / 4 counts at most
    coded = got.column("lang").combine_chunks().dictionary_encode()
    langs, i, n = coded.dictionary.to_pylist(), got.column("i").to_numpy(), got.column("n").to_numpy()
    order = sorted(range(len(langs)), key=langs.__getitem__)
    rank = np.empty(len(langs), np.int64)
    rank[order] = np.arange(len(langs))
    row, script = rank[coded.indices.to_numpy()], i >= 1 << BITS
    grams, scripts = np.zeros((len(langs), 1 << bits), np.float32), np.zeros((len(langs), len(SCRIPTS)))
    grams[row[~script], i[~script]] = n[~script]
    scripts[row[script], i[script] - (1 << BITS)] = n[script]
    return Model([langs[k] for k in order], grams, scripts)


def word_scores(model: Model, gram: np.ndarray, letter: np.ndarray, starts: np.ndarray, ends: np.ndarray, script: np.ndarray) -> np.ndarray:
    """Of every word and language; nought for words without letters."""
    out = np.empty((starts.size, len(model.langs)), np.float32)
    gram = gram >> np.uint32(BITS - model.bits)
    for c in range(len(model.langs)):
        run = np.concatenate([[0.0], np.cumsum(np.where(letter, model.table[gram, c], np.float32(0)), dtype=np.float64)])
        out[:, c] = run[ends] - run[starts]
    out[(script >= 0)[:, None] & ~model.allowed[script]] = -1e4
    out[script < 0] = 0
    return out


def _forward(scores: np.ndarray, begin: np.ndarray, length: np.ndarray, now: np.ndarray, switch: float, stay: np.ndarray | None = None, came: np.ndarray | None = None) -> np.ndarray:
    """Walks runs (begin, length; the longest first) side by side, from the states ``now`` (run, entry, label), which it
    replaces by those after the last word: the best paths' worth there, less what is returned (run, entry).

    Before each word the best state is set to nought, so that numbers stay small however long a run is. ``stay`` and
    ``came`` take how the best paths of a run's first entry got to every word.
    """
    gained = np.zeros(now.shape[:2])
    for t in range(int(length[0]) if length.size else 0):
        k = int(np.searchsorted(-length, -t, "left"))  # runs with more than t words
        i, cur = begin[:k] + t, now[:k]
        top = cur.max(-1)
        gained[:k] += top
        cur -= top[..., None]
        if stay is not None:
            stay[i], came[i] = cur[:, 0] >= -np.float32(switch), cur[:, 0].argmax(-1)
        np.maximum(cur, -np.float32(switch), out=cur)
        cur += scores[i][:, None]
    return gained


def _backward(stay: np.ndarray, came: np.ndarray, begin: np.ndarray, length: np.ndarray, last: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Follows the best paths of the runs back from the labels ``last`` (run, choice) of their last words; returns the
    labels before their first words. ``label`` takes those of every word, of the first choice."""
    for t in range(int(length[0]) - 1 if length.size else -1, -1, -1):
        k = int(np.searchsorted(-length, -t, "left"))
        i, cur = begin[:k] + t, last[:k]
        if label is not None:
            label[i] = cur[:, 0]
        last[:k] = np.where(np.take_along_axis(stay[i], cur, 1), cur, came[i][:, None])
    return last


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH, run: int = RUN) -> np.ndarray:
    """The best label of every word; row k has the words from first[k] to first[k + 1].

    Rows of more than ``run`` words are cut. What a path gains in a run, by the labels before its first word and at its
    last, is a matrix; chained from a row's begin, the matrices give the states that each run is truly entered with.
    """
    words, n = scores.shape
    count = np.diff(first)
    many = np.maximum(1, -(-count // run)) if n <= ENTRIES else np.ones(count.size, np.int64)
    head = np.cumsum(many) - many  # each row's first run
    nth = np.arange(many.sum()) - np.repeat(head, many)
    begin = np.repeat(first[:-1], many) + nth * run
    length = np.where(nth + 1 < np.repeat(many, many), run, np.repeat(count, many) - nth * run)
    entry = np.zeros((nth.size, 1, n), np.float32)
    full = np.flatnonzero(nth + 1 < np.repeat(many, many))  # those that another one follows
    if full.size:
        each = np.full((n, n), -switch, np.float32)
        np.fill_diagonal(each, 0)
        after = np.tile(each, (full.size, 1, 1))
        gained = _forward(scores, begin[full], length[full], after, switch)
        after += (gained - gained.max(1, keepdims=True))[..., None].astype(np.float32)
        place = np.cumsum(nth + 1 < np.repeat(many, many)) - 1
        live, j = np.flatnonzero(many > 1), 0
        while live.size:
            here = head[live] + j
            best = (entry[here, 0][:, :, None] + after[place[here]]).max(1)
            entry[here + 1, 0] = best - best.max(1, keepdims=True)
            j += 1
            live = live[many[live] > j + 1]
        del after
    kind = np.min_scalar_type(max(n - 1, 0))  # wide enough for every label
    stay, came = np.empty((words, n), bool), np.empty(words, kind)
    order = np.argsort(-length, kind="stable")
    now = entry[order]
    _forward(scores, begin[order], length[order], now, switch, stay, came)
    last = np.empty((nth.size, 1), np.int64)
    last[order, 0] = now[:, 0].argmax(1)  # right for the last run of each row
    if full.size:
        later = np.flatnonzero(nth > 0)
        back = later[np.argsort(-length[later], kind="stable")]
        before = np.zeros((nth.size, n), kind)
        before[back] = _backward(stay, came, begin[back], length[back], np.tile(np.arange(n), (back.size, 1)))
        live, j = np.flatnonzero(many > 1), 1
        while live.size:
            here = head[live] + many[live] - j
            last[here - 1, 0] = before[here, last[here, 0]]
            j += 1
            live = live[many[live] > j]
    label = np.empty(words, kind)
    _backward(stay, came, begin[order], length[order], last[order], label)
    return label


def _spans(label, starts, ends, first, script, opens, at, langs):
    """(start, end, language) in characters of each row's runs of one label."""
    char = np.concatenate([[0], np.cumsum(opens)])
    out = []
    for k in range(first.size - 1):
        lo, hi = first[k], first[k + 1]
        turn = np.flatnonzero(np.diff(label[lo:hi])) + 1
        cuts = [0, *turn, hi - lo] if hi > lo else []
        zero = char[at[k]]
        out.append([{"start": int(char[starts[lo + a]] - zero), "end": int(char[ends[lo + b - 1]] - zero), "lang": langs[label[lo + a]]} for a, b in zip(cuts, cuts[1:], strict=False)])
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``lang_pred`` and ``score``; with ``spans`` also ``spans`` (start, end, lang; end exclusive, in characters).

    The predicted language is the one whose words have the most bytes; the score is its share, less the chance that
    the text's words as a whole speak for another.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    more = "lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans

    def make():
        m = held.value
        names = np.array([*m.langs, "und"], object)

        def work(part, data, at):
            rows = at.size - 1
            # words and their scores a step at a time, so that what is kept per byte stays small
            kept, real, base = [], np.zeros(rows, bool), 0
            for some, raw, bounds in steps(part, text_col):
                a, b, f, gram, letter, s = _words(raw, bounds)
                places = (a + at[base], b + at[base]) if spans else (None, None)
                kept.append(((b - a).astype(np.int32), np.diff(f), s.astype(np.int8), word_scores(m, gram, letter, a, b, s), *places))
                ascii_letter = np.concatenate([[0], np.cumsum(letter & (raw < 0x80))])[bounds]
                wide = np.concatenate([[0], np.cumsum(raw >= 0x80)])[bounds]
                has = ascii_letter[1:] > ascii_letter[:-1]
                for k in np.flatnonzero(~has & (wide[1:] > wide[:-1])):
                    has[k] = any(c.isalpha() for c in raw[bounds[k] : bounds[k + 1]].tobytes().decode())
                real[base : base + some.num_rows] = has
                base += some.num_rows
            size, counts, script, scores = (np.concatenate([k[i] for k in kept]) for i in range(4))
            starts, ends = (np.concatenate([k[i] for k in kept]) if spans else None for i in (4, 5))
            del kept
            first = np.concatenate([[0], np.cumsum(counts)])
            n = len(m.langs)
            if not n or not size.size:
                pred, score, found = np.full(rows, n), np.zeros(rows), [[] for _ in range(rows)]
            else:
                row = np.repeat(np.arange(rows), counts)
                label = viterbi(scores, first)
                weight = np.where(script >= 0, size, 0)
                share = np.bincount(row * n + label.astype(np.int64), weight, rows * n).reshape(rows, n)
                total = np.stack([np.bincount(row, scores[:, c], rows) for c in range(n)], 1)
                pred = share.argmax(1)
                part_of = share[np.arange(rows), pred] / np.maximum(share.sum(1), 1)
                other = total - total[np.arange(rows), pred][:, None]
                other[np.arange(rows), pred] = -np.inf
                score = part_of / (1 + np.exp(np.clip(other.max(1) if n > 1 else np.full(rows, -50.0), -50, 0)))
                pred = np.where(real, pred, n)
                score = np.where(real, np.clip(score, 0, 1), 0)
                found = _spans(label, starts, ends, first, script, (data & 0xC0) != 0x80, at, m.langs) if spans else None
            cols = [pa.array(names[pred].tolist(), pa.string()), pa.array(score, pa.float64())]
            if spans:
                cols.append(pa.array([f if r else [] for f, r in zip(found, real, strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            return cols

        return work

    return extend(docs, make, more, text_col, GROUP_BYTES, drop)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(crc_bucket("doc_id", 3) != 1))
    held_out = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return identify(docs.drop("lang"), model, drop=("text",)).select("doc_id", held_out, "lang_pred", "score")
