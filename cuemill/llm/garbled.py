"""Texts that were decoded with a wrong encoding, and their restoration.

1. The distinct words of the corpus are counted; those of one script are held
   for clean, and every form they take under every chain of right and wrong
   encodings is generated, with what the replacement character turns into.
   Scripts without spaces give characters and pairs of characters instead of
   words. Forms with signs or pairs of signs the corpus doesn't have are left
   out before they are sent anywhere.
2. The distinct words of the texts, and their pieces, are joined by hash with
   that table. A word is garbled if its pieces are forms of clean words by one
   chain, and the clean words are the more frequent ones unless the form alone
   shows the direction; or if it holds a form of the replacement character.
3. Verified originals are put back into the texts. Words that have lost bytes
   get the only clean word that could have stood there, if there is just one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.encodings import DOUBLE, RUN, byte_pairs, forms, residues, script, wide_forms
from cuemill.session import materialize

_WORD = r"(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7f][^\x00-\x40\x5b-\x60\x7b-\x7f]*+"  # letters and signs, not all of them ASCII
_LONE = r"(?:^|[\n>])([^\x00-\x7f\s] [A-Za-z]+)"  # a sign before a word is judged with it
_CONTROL = r"[\x00-\x08\x0e-\x1f]"
_BYTES = r"[^ \t\n\r]*[\x00-\x08\x0e-\x1f][^ \t\n\r]*"  # single bytes of wider units, or escapes
_STRANGE = r"[^\t-\r\x20-\x7f]"  # controls and all that isn't ASCII
_WIDTHS = {"c1": 1, "c2": 2, "c3": 3, "b3": 3}
_SLOTS = 1 << 20
_LOST = {w for form in residues() for w in (len(form),)}
_LOST_HEADS = {form[0] for form in residues()}


def _words(text: Column) -> Column:
    """Words of a text that aren't plain ASCII, and runs with controls."""
    found = [F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.regexp_extract_all(text, F.lit(_LONE), F.lit(1))]
    raw = F.transform(F.regexp_extract_all(text, F.lit(_BYTES), F.lit(0)), lambda w: F.regexp_replace(w, r"^\x00+|\x00+\z", ""))
    bytewise = F.when(text.rlike(_CONTROL), F.filter(raw, lambda w: w.rlike(_CONTROL))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*found, bytewise))


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, kind, script, n): neighbouring ASCII characters of all texts, at most 128 * 128 rows a task."""
    sums = np.zeros(1 << 14, np.int64)
    for batch in batches:
        texts = batch.column(0).drop_null()
        if not len(texts):
            continue
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        data = np.frombuffer("".join(texts.to_pylist()).encode("utf-8", "replace"), np.uint8).astype(np.int32)
        inner = np.ones(len(data), bool)
        inner[ends[(ends > 0) & (ends <= len(data))] - 1] = False  # no pair over the end of a text
        good = inner[:-1] & (data[:-1] < 128) & (data[1:] < 128)
        sums += np.bincount(data[:-1][good] << 7 | data[1:][good], minlength=1 << 14)
    at = np.flatnonzero(sums)
    pairs = [chr(i >> 7) + chr(i & 127) for i in at.tolist()]
    yield pa.RecordBatch.from_pydict({"unit": pa.array(pairs, pa.string()), "kind": pa.array(["p"] * len(at), pa.string()), "script": pa.array(["latin"] * len(at), pa.string()), "n": sums[at]})


def _bounded(rows: Iterator[tuple], place: int, chars: int = 1_000_000) -> Iterator[list[tuple]]:
    """Lists of rows whose texts at ``place`` have together about ``chars`` characters at most."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[place]) + 50
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _chunked(rows: Iterator[tuple], fields: dict[str, pa.DataType], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size, so that a worker never holds all rows a batch expands to."""
    for part in _bounded(rows, list(fields.values()).index(pa.string()), 100 * size):
        yield pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in part], kind) for i, (name, kind) in enumerate(fields.items())})


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clean words and parts of words that garbled forms are made of: (unit, kind, script, n)."""
    for batch in batches:
        seen: dict[tuple[str, str, str], int] = {}

        def add(unit: str, kind: str, writing: str, n: int) -> None:
            seen[unit, kind, writing] = seen.get((unit, kind, writing), 0) + n

        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            writing = script(word)
            if writing is None:
                continue
            if word.isascii():
                add(word, "a", writing, n)
                continue
            if writing in ("cjk", "hangul"):
                for ch in word:
                    add(ch, "c" if writing == "cjk" else "e", writing, n)
            if writing == "cjk":
                for a, b in zip(word, word[1:]):
                    add(a + b, "b", writing, n)
            add(word, "w", writing, n)
            for run in RUN.findall(word):
                if run != word:
                    add(run, "r", "sign" if script(run) == "sign" else writing, n)
            if writing == "sign":
                add(word, "r", writing, n)
        fields = {"unit": pa.string(), "kind": pa.string(), "script": pa.string(), "n": pa.int64()}
        yield from _chunked(((*key, n) for key, n in seen.items()), fields)


def _keyed(unit: str, kind: str, writing: str, met: Callable[[str], bool] | None = None) -> Iterator[tuple[str, str, str]]:
    """(kind of piece, form, chain) of every form of a unit that a piece may have."""
    if kind == "p":  # two bytes taken for one wide unit
        for code in ("utf-16-le", "utf-16-be"):
            form = unit.encode("ascii").decode(code, "replace")
            if "�" not in form:
                yield "c1", form, f"ascii>{code}"
        return
    if kind == "a":
        for form, chain in wide_forms(unit).items():
            yield "w_", form, chain
        return
    if kind in "ce":
        for form, chain in byte_pairs(unit).items():
            yield "e2", form, chain
        if kind == "e":
            return
    for form, chain in forms(unit, writing, kind == "b", kind in "wr", met).items():
        from_utf8, double = chain.startswith("utf-8"), chain.split(">")[1] in DOUBLE
        if kind == "w":
            yield "w_", form, chain
        elif "�" in form:
            continue
        elif kind == "r" and from_utf8 and len(form) > len(unit):
            yield "r_", form, chain
        elif kind == "c" and not double and len(form) in (2, 3) and (len(form) == 3) == from_utf8:
            yield f"c{len(form)}", form, chain
        elif kind == "c" and double and not from_utf8 and len(form) == 1:
            yield "c1", form, chain
        elif kind == "b" and double and from_utf8 and len(form) == 3:
            yield "b3", form, chain


def _slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every sign and of every pair of neighbours, number of the text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), sizes)
    same = of[1:] == of[:-1]
    mix = lambda a, b: ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(44)).astype(np.int64) % _SLOTS
    return np.concatenate([mix(code, np.uint64(0)), mix(code[:-1][same], code[1:][same] + np.uint64(1))]), np.concatenate([of, of[1:][same]])


def _seen_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(_SLOTS, bool)
    for batch in batches:
        if batch.num_rows:
            seen[_slots(batch.column(0).to_pylist())[0]] = True
    yield pa.RecordBatch.from_pydict({"slot": pa.array(np.flatnonzero(seen).astype(np.int32))})


def _parts(word: str) -> Iterator[tuple[str, int, int]]:
    """(key, place, wide or narrow characters): every way a word may consist of forms."""
    runs = [(m.start(), m.group()) for m in RUN.finditer(word)]
    yield "w_" + word, 0, sum(len(r) for _, r in runs)
    if not word.isascii():
        for at, run in runs:
            if 1 < len(run):
                yield "r_" + run, at, len(run)
            for width in _LOST:
                for i in range(len(run) - width + 1):
                    if run[i] in _LOST_HEADS:
                        yield "l_" + run[i : i + width], at + i, width
            wide = [ch >= "⺀" for ch in run]
            for kind, width in _WIDTHS.items():
                if not (any(wide) if kind in ("c1", "b3") else not all(wide)):
                    continue  # wide characters come from double-byte readings only, narrow ones from the others
                for i in range(0, len(run) - width + 1, width):
                    yield kind + run[i : i + width], at + i, width
    for head, tail in (("\x1b$B", "\x1b("), ("\x1b$@", "\x1b("), ("\x0e", "\x0f")):
        start = word.find(head)
        while start >= 0:
            start += len(head)
            stop = word.find(tail, start)
            stop = len(word) if stop < 0 else stop
            for i in range(start, stop - 1, 2):
                yield "e2" + word[i : i + 2], i, 2
            start = word.find(head, stop)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wid, key, place): place holds the piece's start and its non-ASCII characters."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for wid, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key, at, chars in _parts(word):
                    yield wid, key, at << 24 | chars

    yield from _chunked(rows(), {"wid": pa.int64(), "key": pa.string(), "place": pa.int64()})


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[str, int] = {}
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for key, _, _ in _parts(word):
                seen[key] = seen.get(key, 0) + n
        yield from _chunked(iter(seen.items()), {"key": pa.string(), "n_piece": pa.int64()})


def _about(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wid, word, n_word, total, letters, clean) of each word."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for wid, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                total = len("".join(RUN.findall(word)))
                yield wid, word, n, total, len(word) - total, script(word) in ("latin", "cyrillic", "hangul")

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    yield from _chunked(rows(), dict(zip(("wid", "word", "n_word", "total", "letters", "clean"), kinds)))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, chain, restored): the word with its matched pieces replaced; null if a piece is left over."""
    for batch in batches:
        out = []
        for word, parts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            made, at = [], 0
            for p in sorted(parts, key=lambda p: p["at"]):
                made += [word[at : p["at"]], p["unit"]]
                at = p["at"] + len(p["piece"])
            left = len("".join(RUN.findall(word))) - sum(len("".join(RUN.findall(p["piece"]))) for p in parts)
            whole = "".join([*made, word[at:]])
            for mark in ("\x1b$B", "\x1b$@", "\x1b(B", "\x1b(J", "\x1b$)C", "\x0e", "\x0f"):
                whole = whole.replace(mark, "")
            out.append(None if left else whole)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], names=["word", "chain", "restored"])


def garbled_words(words: DataFrame, pairs: DataFrame, plain: DataFrame, restore: bool) -> tuple[DataFrame, DataFrame | None]:
    """(word, chain, restored) of the garbled ones among the counted words (wid, word, n); wid tells words apart.

    ``pairs`` has the counts of neighbouring ASCII characters as units,
    ``plain`` the counted words of ASCII only; they are looked at only if some
    word has controls, as theirs are no other forms.

    The second table, made with ``restore``, has whole words that match too but
    are too short or too frequent to tell alone; they count where their text
    has the same chain.
    """
    spark = words.sparkSession
    strange = words
    if words.where(F.col("word").rlike(_CONTROL)).isEmpty():
        plain = plain.limit(0)
    slots = strange.select("word").mapInArrow(_seen_slots, "slot int").distinct().toArrow()["slot"].to_numpy()  # at most _SLOTS numbers
    seen = np.zeros(_SLOTS, bool)
    seen[slots] = True
    shown = spark.sparkContext.broadcast(np.packbits(seen))

    def make_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, chain, unit, n) for every chain; a key is the kind of piece and the form."""
        known = np.unpackbits(shown.value)[:_SLOTS].astype(bool)
        begun: dict[str, bool] = {}

        def met(start: str) -> bool:
            if start not in begun:
                begun[start] = bool(known[_slots([start])[0]].all())
            return begun[start]

        rows = ((piece, form, chain, unit, n) for b in batches for unit, kind, writing, n in zip(*(c.to_pylist() for c in b.columns)) for piece, form, chain in _keyed(unit, kind, writing, met) if form)
        for part in _bounded(rows, 1):
            texts = [p[1] for p in part if p[0] != "e2"]
            keep = np.ones(len(part), bool)
            if texts:
                slot, of = _slots(texts)
                at = np.flatnonzero([p[0] != "e2" for p in part])
                keep[at[np.unique(of[~known[slot]])]] = False
            part = [p for p, k in zip(part, keep) if k]
            columns = ([p[0] + p[1] for p in part], *([p[i] for p in part] for i in (2, 3, 4)))
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("key", "chain", "unit", "n"), columns, (pa.string(), pa.string(), pa.string(), pa.int64()))})

    schema = "unit string, kind string, script string, n bigint"
    parts_of = words.select("word", "n").unionByName(plain.select("word", "n")).mapInArrow(_units, schema).unionByName(pairs)
    units = parts_of.groupBy("unit", "kind").agg(F.sum("n").alias("n"), F.max("script").alias("script"))
    table = units.select("unit", "kind", "script", "n").mapInArrow(make_forms, "key string, chain string, unit string, n bigint")
    lost = spark.createDataFrame([("l_" + form, chain, None, 0) for form, chain in residues().items()], "key string, chain string, unit string, n bigint")
    asked = strange.select("word", "n").mapInArrow(_asked, "key string, n_piece bigint").groupBy("key").agg(F.sum("n_piece").alias("n_piece"))
    pieces = strange.select("wid", "word").mapInArrow(_pieces, "wid bigint, key string, place bigint")
    about = strange.select("wid", "word", "n").mapInArrow(_about, "wid bigint, word string, n_word bigint, total int, letters int, clean boolean")
    forms_met = table.unionByName(lost).join(asked, "key").where(~F.col("key").startswith("c1") | (F.col("n") >= F.col("n_piece")))
    by_key = materialize(forms_met.groupBy("key", "chain").agg(F.max(F.struct("n", "unit")).alias("b"), F.sum("n").alias("all"), F.first("n_piece").alias("n_piece")))
    lossy = F.col("key").contains("�") & ~F.col("key").startswith("l_")
    # Where bytes are lost, several words may have stood: one must be far ahead of all others, by whatever chain.
    sole = by_key.where(lossy & F.col("key").rlike(r"[^�w_].*[^�]")).groupBy("key").agg(F.max_by(F.struct("chain", "b", "n_piece"), F.struct("b.n", "chain")).alias("t"), F.sum("all").alias("all"))
    sole = sole.where("t.b.n >= 3 * (all - t.b.n)").select("key", "t.chain", "t.b", "t.n_piece")
    gain = F.log(F.greatest(F.col("b.n"), F.lit(1)).cast("double")) - F.log(F.col("n_piece").cast("double"))
    matched = by_key.where(~lossy).select("key", "chain", "b", "n_piece").unionByName(sole).select("key", "chain", "b.unit", "b.n", gain.alias("gain"))
    kind = F.substring("key", 1, 2).alias("kind")
    by_chain = (
        pieces.join(matched.select("key", "chain", "n", "gain"), "key")
        .groupBy("wid", kind, "chain")
        .agg(
            F.sum(F.col("place").bitwiseAND(F.lit((1 << 24) - 1))).alias("chars"), F.count("*").alias("matched"), F.max("n").alias("n"), F.min("n").alias("least"),
            F.avg("gain").alias("gain"), F.max(F.substring("key", 3, 1).between("†", "ⁿ")).alias("spaced"),  # a space is the other half
        )
        .join(about, "wid")
    )
    share = F.col("chars") / F.greatest(F.col("total"), F.lit(1))
    telling = (F.col("total") > 1) | (F.col("letters") > 1) | ((F.col("letters") > 0) & ~F.col("clean"))
    least = lambda clean, other: F.when(F.col("clean"), clean).otherwise(other)
    bytewise = F.col("chain").startswith("utf-16") | F.col("chain").startswith("iso2022")
    verified = (
        F.when(F.col("kind") == "l_", F.lit(True))
        .when(bytewise, F.when(F.col("kind") == "e2", F.col("matched") >= 2).otherwise(F.length("word") > 2))
        .when((F.col("kind") == "w_") & F.col("word").contains("�"), F.lit(True))
        .when(F.col("kind") == "w_", telling & (F.col("n") >= F.when(F.col("chain").startswith("utf-8"), F.when(F.col("total") > 1, 1).otherwise(2 * F.col("n_word"))).otherwise(3 * F.col("n_word"))))
        .when(F.col("kind") == "r_", share == 1)
        .when(F.col("chain").startswith("ascii"), (share >= 0.7) & (F.col("matched") >= 3) & F.col("spaced"))
        .when(F.col("kind") == "c1", (share >= 0.9) & (F.col("matched") >= 3) & (F.col("gain") > math.log(3)))
        .otherwise((share >= least(1.0, 0.7)) & (F.col("matched") >= 2) & (F.col("least") >= least(10, 2) * F.col("n_word")))
    )
    order = F.struct((F.col("kind") != "l_").cast("int"), (F.col("kind") == "w_").cast("int"), share, F.col("gain"), F.col("chain"))
    chosen = by_chain.where(verified).groupBy("wid").agg(F.max_by(F.struct("word", "chain", "kind"), order).alias("b")).select("wid", "b.*")
    if not restore:
        return chosen.select("word", "chain", F.lit(None).cast("string").alias("restored")), None
    chosen = materialize(chosen)
    units_of = matched.where("unit IS NOT NULL").select("key", "chain", "unit")
    parts = (
        pieces.join(chosen.where("kind <> 'l_'").select("wid", "chain", F.col("kind").alias("__kind")), "wid")
        .where(F.substring("key", 1, 2) == F.col("__kind"))
        .join(units_of, ["key", "chain"])
        .groupBy("wid")
        .agg(F.collect_list(F.struct((F.col("place") / (1 << 24)).cast("int").alias("at"), F.substring("key", 3, 1 << 20).alias("piece"), "unit")).alias("parts"))
    )
    rebuilt = chosen.join(parts, "wid").select("word", "chain", "parts").mapInArrow(_rebuild, "word string, chain string, restored string")
    lost_words = chosen.where("kind = 'l_'").select("word", "chain", F.lit(None).cast("string").alias("restored"))
    weak = by_chain.where((F.col("kind") == "w_") & ~verified).select("word", "chain", F.concat(F.lit("w_"), "word").alias("key")).join(units_of, ["key", "chain"]).select("word", "chain", F.col("unit").alias("restored"))
    return rebuilt.unionByName(lost_words), weak


def find_garbled(df: DataFrame, keys: list[str], text: str, restore: bool = True) -> DataFrame:
    """(keys, chains, restored): the rows whose text is garbled, wholly or in part.

    ``restored`` is the text with all garbled words replaced, null when one of
    them can't be restored or ``restore`` is off. Repeated rows come out once;
    null, blank and plain ASCII texts without controls are never garbled. Other
    columns are left out.
    """
    texts = df.select(*keys, F.col(text).alias("__text"))
    suspects = texts.where(F.col("__text").rlike(_STRANGE))
    each = suspects.select(*keys, *["__text"] * restore, F.explode(_words(F.col("__text"))).alias("word"))
    counted = each.groupBy("word").agg(F.count("*").alias("n"))
    words = materialize(counted.withColumn("wid", F.monotonically_increasing_id()))
    plain = texts.select(F.explode(F.split("__text", "[ \t\r\n]+")).alias("word")).where((F.col("word") != "") & ~F.col("word").rlike(_STRANGE)).groupBy("word").agg(F.count("*").alias("n"))
    pairs = texts.select("__text").mapInArrow(_pair_counts, "unit string, kind string, script string, n bigint")
    bad, weak = garbled_words(words, pairs, plain, restore)
    bad = materialize(bad)
    chains = F.array_sort(F.collect_set("chain")).alias("chains")
    if not restore:
        return each.join(bad, "word").groupBy(*keys).agg(chains).select(*keys, "chains", F.lit(None).cast("string").alias("restored"))
    swap = F.struct((-F.length("word")).alias("o"), "word", "restored")
    found = each.join(bad, "word").groupBy(*keys, "__text").agg(
        chains, F.bool_and(F.col("restored").isNotNull()).alias("whole"), F.collect_set(swap).alias("swaps")
    )
    found = found.withColumn("__row", F.struct(*keys, "__text"))
    more = (
        found.where("whole")
        .select("__row", "chains", F.explode(_words(F.col("__text"))).alias("word"))
        .join(weak, "word")
        .where(F.array_contains("chains", F.col("chain")))
        .groupBy("__row")
        .agg(F.collect_set(swap).alias("more"))
    )
    swaps = F.array_sort(F.array_union("swaps", F.coalesce("more", F.array().cast("array<struct<o:int,word:string,restored:string>>"))))
    swapped = F.aggregate(swaps, F.col("__text"), lambda t, s: F.replace(t, s["word"], s["restored"]))
    wide = F.when(F.array_contains(F.transform("chains", lambda c: c.startswith("utf-16")), True), F.regexp_replace(swapped, "\x00", "")).otherwise(swapped)
    restored = F.when(F.col("whole") & ~wide.rlike(_CONTROL + "|�|[\x80-\x84\x86-\x9f]"), wide)  # nothing strange may be left
    return found.join(more, "__row", "left").select(*keys, "chains", restored.alias("restored"))
