"""Line deduplication by a log-template tree of fixed depth.

A line's tokens are its words between white space; those with a digit are variable and read <*>. The tree's levels are
the number of tokens and the first DEPTH tokens. A leaf's lines, most frequent first, join the first of its templates
with SIMILAR of their tokens equal, or found a new one; in the template's spelling the places that differ become <*>.
A template is matched as it was founded, so a leaf may be parsed in rounds: its LINES most frequent lines (fewer of long
ones, TOKENS together) found templates in one task; then all its other lines, dealt over tasks, join these; those left
do so again. The templates are the same whatever a round holds.

A template recurs when at least DOCUMENTS unlike documents hold it, however many copies there are of any of them. Two
of its documents are alike when all their other lines begin alike (DEPTH first tokens) or all end alike (DEPTH last
tokens), or when both are like a third one; unless their own lines tell them apart. Among documents whose lines all
begin alike, a beginning is own when no line with it stands in half of them and either no ending does, or they differ
in digits only; such lines, as a title or a time stamp are, must be equal in alike documents (and so with endings). In
near copies with a word edited here or there most documents have each line as it was, so nothing is own.

So boilerplate and passages spread over unlike documents are dropped wherever they stand and however the documents'
other lines look, while the lines of a group of copies or near copies stay, as the group counts once; such groups are
the near-duplicate stage's to judge.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import over_cores
from .common import FILTER_BITS, attach_by_key, connected_components, discard, id_filter, materialize, partitions, read_table, runs_of, slices, split_by_filter, tidy, utf8_view

DEPTH = 3
SIMILAR = 0.7
DOCUMENTS = 5
#: What of a leaf founds templates in one round, and what a task holds of it: lines, and tokens (but one line at least).
LINES, TOKENS = 8192, 1 << 20
#: A leaf's key holds the number of tokens (as many as these bits can say) above HASH_BITS bits of a hash.
HASH_BITS, WIDTH_BITS = 44, 19
#: Recurring lines up to which their keys (8 bytes each) go to every task; beyond, each document's are joined to it.
RECURRING = 1_000_000
_DIGIT = re.compile("[0-9]")
_HALF = 1 << 63


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: White space but the blank and the line end.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def traits(text: str) -> tuple[bool, bool]:
    """Whether a text's lines are their tokens with one blank between each, and whether it has a digit."""
    odd = "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _OTHER_SPACE)
    return not odd, bool(_DIGIT.search(text))


def spelled(line: str, plain: bool, digits: bool) -> tuple[str, str]:
    """A line's tokens with one blank between each: with those that have a digit as <*>, and as they are."""
    if digits and _DIGIT.search(line):
        own = line.split()
        return " ".join(["<*>" if _DIGIT.search(t) else t for t in own]), " ".join(own)
    own = line if plain else " ".join(line.split())
    return own, own


def leaf_of(tokens: str) -> int:
    n = tokens.count(" ") + 1
    return min(n, (1 << WIDTH_BITS) - 1) << HASH_BITS | _hash(f"{n} {begin(tokens)}") & ((1 << HASH_BITS) - 1)


def begin(tokens: str) -> str:
    return " ".join(tokens.split(" ", DEPTH)[:DEPTH])


def end(tokens: str) -> str:
    return " ".join(tokens.rsplit(" ", DEPTH)[-DEPTH:])


def parse(line: str) -> tuple[int, int, list[str]] | None:
    """(leaf, line key, tokens) of a line; None for a blank one."""
    tokens = spelled(line, False, True)[0]
    return (leaf_of(tokens), _hash(tokens), tokens.split(" ")) if tokens else None


def at_once(lines: int = LINES, tokens: int = TOKENS) -> Column:
    """Lines of a leaf that found templates in one round; one of lines too long for the leaf's key to tell their length."""
    width = F.shiftright("leaf", HASH_BITS)
    fit = F.greatest(F.lit(1), F.least(F.lit(lines), F.floor(F.lit(tokens) / width)))
    return F.when(width < (1 << WIDTH_BITS) - 1, fit).otherwise(1).cast("int")


def _wrapped(n: int) -> int:
    return (n + _HALF) % (2 * _HALF) - _HALF


def exact_lines(text: str) -> dict[int, tuple[str, str]]:
    """{key: (tokens with <*>, tokens as they are)} of a text's different lines."""
    out, (plain, digits) = {}, traits(text)
    for line in set(text.split("\n")):
        form, own = spelled(line, plain, digits)
        if form:
            out[_hash(form) if form is own else _hash("\0" + own)] = form, own
    return out


def company(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For the ends of each line of a document, one key for all other beginnings and one for all other ends."""
    heads, tails = sum({h for h, _ in found}), sum({t for _, t in found})
    return [(_wrapped(heads - h), _wrapped(tails - t)) for h, t in found]


class Leaf:
    """A leaf's templates as they were founded, of lines of one length."""

    def __init__(self, width: int):
        self.words: dict[str, int] = {}
        self.templates, self.size = np.zeros((4, width), np.int64), 0

    def first(self, tokens: list[str]) -> tuple[int | None, np.ndarray]:
        """The first template that a line is similar to, None where there is none; the line's codes."""
        row = np.array([self.words.setdefault(t, len(self.words)) for t in tokens], np.int64)
        near = (self.templates[: self.size] == row).sum(axis=1) >= SIMILAR * len(row)
        return (int(near.argmax()) if self.size and near.any() else None), row

    def add(self, tokens: list[str]) -> int:
        """The number of the template that a line joins or founds."""
        t, row = self.first(tokens)
        if t is not None:
            return t
        if self.size == len(self.templates):
            self.templates = np.concatenate([self.templates, np.zeros_like(self.templates)])
        self.templates[self.size] = row
        self.size += 1
        return self.size - 1


def spelling(lines: list[list[str]]) -> str:
    """A template's spelling: the founder's tokens, <*> where another of its lines differs."""
    return " ".join(ts[0] if len(set(ts)) == 1 else "<*>" for ts in zip(*lines))


def grow(lines: list[list[str]]) -> list[int]:
    """The template of each of a leaf's lines, all of one length and in the order given, as the number of its first line."""
    leaf, first = Leaf(len(lines[0])), []
    found = [leaf.add(tokens) for tokens in lines]
    for k, t in enumerate(found):
        if t == len(first):
            first.append(k)
    return [first[t] for t in found]


def found_templates(rows: DataFrame) -> DataFrame:
    """(leaf, line, template, companies, documents) of lines (leaf, line, tokens, companies, documents), whole leaves each in
    one task; a template is named by the line that founds it."""
    ordered = (
        rows.select("leaf", (-F.col("documents")).alias("rank"), "line", "tokens", "companies")
        .repartition(partitions(rows.sparkSession), "leaf")
        .sortWithinPartitions("leaf", "rank", "line")
    )

    def run(batches):
        for table in runs_of(batches, 1):
            line = table["line"].to_numpy()
            first = grow([t.split(" ") for t in table["tokens"].to_pylist()])
            out = {"leaf": table["leaf"], "line": line, "template": line[first], "companies": table["companies"], "documents": pa.array(-table["rank"].to_numpy())}
            yield from pa.table(out).combine_chunks().to_batches()

    return ordered.mapInArrow(tidy(run), "leaf long, line long, template long, companies long, documents long")


def in_rounds(rows: DataFrame, lines: int, tokens: int) -> DataFrame:
    """found_templates() of leaves that are too large for one task; rows also hold n, the number of the leaf's lines."""
    schema = "leaf long, line long, tokens string, companies long, documents long, n long, template long"
    names = [c.split()[0] for c in schema.split(", ")]
    most, own = at_once(lines, tokens), ["leaf", "line", "template", "companies", "documents"]
    rest, done = materialize(rows.select(*names[:-1]), "large-leaves"), []

    def join_templates(left: pa.Table, right: pa.Table) -> pa.Table:
        # the order in which they were founded
        right = right.sort_by([("documents", "descending"), ("template", "ascending")])
        founders, template, out = [t.split(" ") for t in right["tokens"].to_pylist()], right["template"].to_pylist(), []
        leaf = Leaf(len(founders[0])) if founders else None
        if leaf is not None:
            leaf.templates = np.array([[leaf.words.setdefault(t, len(leaf.words)) for t in f] for f in founders], np.int64)
            leaf.size = len(founders)
        for line in left["tokens"].to_pylist():
            t = leaf.first(line.split(" "))[0] if leaf is not None else None
            out.append(None if t is None else template[t])
        return left.select(names[:-1]).append_column("template", pa.array(out, pa.int64()))

    while not rest.isEmpty():
        w = Window.partitionBy("leaf").orderBy(F.desc("documents"), "line")
        first = materialize(rest.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= lines).where(F.col("_n") <= most).drop("_n"), "first-lines")
        founded = materialize(found_templates(first), "founded")
        founders = first.join(founded.where("line = template").select("leaf", "line"), ["leaf", "line"]).select("leaf", F.col("line").alias("template"), "tokens", "documents", F.ceil(F.col("n") / most).cast("int").alias("shares"))
        others = rest.join(first.select("leaf", "line"), ["leaf", "line"], "left_anti")
        dealt = others.withColumn("share", F.pmod(F.xxhash64("line"), F.ceil(F.col("n") / most).cast("int")).cast("int"))
        spread = founders.select("leaf", "template", "tokens", "documents", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        joined = dealt.groupBy("leaf", "share").cogroup(spread.groupBy("leaf", "share")).applyInArrow(join_templates, schema)
        joined = materialize(joined, "joined")
        done += [founded.select(*own), joined.where("template is not null").select(*own)]
        discard(rest)
        rest = materialize(joined.where("template is null").drop("template"), "large-leaves")
    return reduce(DataFrame.unionByName, done)


def _texts(batch, at: int):
    """(first, texts) of runs of a batch's texts of bounded size."""
    _, offsets = utf8_view(batch.column(at))
    for a, b in slices(offsets, 4 << 20):
        yield a, [t or "" for t in batch.column(at).slice(a, b - a).to_pylist()]


LINE = "doc_id long, text long, leaf long, line long, heads long, tails long"


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text, leaf, line, heads, tails): each different line of each document, with its company; text: a key of all
    its lines. A row without leaf is the document itself, with all its beginnings and endings."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for a, texts in _texts(batch, 1):
                rows = []
                for i, text in enumerate(texts):
                    exact = exact_lines(text)
                    if not exact:
                        continue
                    found = {form: k if form is own else None for k, (form, own) in exact.items()}
                    both = [(_hash(begin(f)), _hash(end(f))) for f in found]
                    ident, key = ids[a + i].as_py(), _wrapped(sum(exact))
                    rows += [(ident, key, leaf_of(f), _hash(f) if k is None else k, *by) for (f, k), by in zip(found.items(), company(both))]
                    rows.append((ident, key, None, None, _wrapped(sum({h for h, _ in both})), _wrapped(sum({t for _, t in both}))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in LINE.split(", ")])

    return docs.mapInArrow(tidy(run), LINE)


def told_apart(docs: DataFrame, lines: DataFrame, documents: int) -> DataFrame:
    """lines without the documents' rows, and with the company of documents whose own lines tell them apart changed by these.

    Only documents whose beginnings or whose endings all are those of `documents` different texts or more are read again,
    one for each text.
    """
    whole = lines.where("leaf is null").select("doc_id", "text", F.col("heads").alias("h"), F.col("tails").alias("t"))
    lines = lines.where("leaf is not null")
    each = materialize(whole.groupBy("text", "h", "t").agg(F.min("doc_id").alias("doc_id")), "texts")
    # both sides are counted and joined at once, as each shuffle costs the driver a task for each partition
    sides = each.select("doc_id", "text", F.posexplode(F.array("h", "t")).alias("side", "alike"))
    large = materialize(sides.groupBy("side", "alike").agg(F.count("*").alias("n")).where(F.col("n") >= documents).select("side", "alike"), "large")
    some = materialize(sides.join(large, ["side", "alike"], "left_semi").select("doc_id", "text").where("doc_id is not null").distinct(), "alike")
    if some.isEmpty():
        return lines

    def read(batches):
        for batch in batches:
            for a, texts in _texts(batch, 1):
                wanted, rows = batch.column(2).slice(a, len(texts)).to_pylist(), []
                for text, want in zip(texts, wanted):
                    exact = exact_lines(text)
                    if _wrapped(sum(exact)) != want:
                        continue  # another row with this id
                    ends_ = [(_hash(begin(form)), _hash(end(form))) for form, _ in exact.values()]
                    h, t = (_wrapped(sum({e[k] for e in ends_})) for k in (0, 1))
                    for (k, (form, own)), (head, tail) in zip(exact.items(), ends_):
                        leaf, line = leaf_of(form), _hash(form)
                        rows.append((want, leaf, line, k, h, head, _hash(end(own))))
                        rows.append((want, leaf, line, k, t, tail, _hash(begin(own))))
                if rows:
                    side = pa.array(np.arange(len(rows), dtype=np.int32) % 2)
                    yield pa.RecordBatch.from_arrays([side, *(pa.array(c, pa.int64()) for c in zip(*rows))], ["side", "text", "leaf", "line", "exact", "alike", "end", "other"])

    bits = id_filter(some.select("doc_id"))
    # an id whose rows have one text gives it once for each row; equal rows are one text
    near = split_by_filter(docs, "doc_id", bits, inside=True).join(some.withColumnRenamed("text", "key"), "doc_id").select("doc_id", docs.columns[1], "key")
    own = near.mapInArrow(tidy(read), "side int, text long, leaf long, line long, exact long, alike long, end long, other long").distinct()
    own = materialize(own.join(large, ["side", "alike"], "left_semi"), "near-lines")
    at = ["side", "alike", "end"]
    kinds = ["exact", "other", "line"]
    shares = own.select(*at, F.posexplode(F.array(*kinds)).alias("kind", "k")).groupBy(*at, "kind", "k").agg(F.count("*").alias("n"))
    of = lambda k: F.when(F.col("kind") == k, F.col("n"))
    shares = shares.groupBy(*at).agg(*[f(of(k)).alias(f"{name}_{c}") for k, c in enumerate(kinds) for name, f in (("top", F.max), ("all", F.sum))])
    least = lambda c: 2 * F.col(f"top_{c}") < F.col(f"all_{c}")
    marks = shares.where(least("exact") & (least("other") | ~least("line"))).select(*at)
    told = materialize(own.join(marks, at, "left_semi"), "own-lines")
    if told.isEmpty():
        return lines
    # what a text's own lines add to its company, but a line to its own
    by_text = told.groupBy("text").pivot("side", [0, 1]).agg(F.bit_xor(F.xxhash64("exact"))).select("text", F.coalesce("0", F.lit(0).cast("long")).alias("h"), F.coalesce("1", F.lit(0).cast("long")).alias("t"))
    by_line = told.groupBy("text", "leaf", "line").pivot("side", [0, 1]).agg(F.bit_xor(F.xxhash64("exact"))).select("text", "leaf", "line", F.coalesce("0", F.lit(0).cast("long")).alias("own_h"), F.coalesce("1", F.lit(0).cast("long")).alias("own_t"))
    by_text = materialize(by_text, "told-apart")
    bits = id_filter(by_text.select("text"))
    sizes = lines.select("text").join(by_text.select("text"), "text", "left_semi").groupBy("text").agg(F.count("*").alias("n"))
    maybe = split_by_filter(lines, "text", bits, inside=True)
    changed = attach_by_key(maybe, materialize(by_text.join(sizes, "text"), "told-sizes"), "text", "n").drop("n").join(by_line, ["text", "leaf", "line"], "left")
    nought = F.lit(0).cast("long")
    changed = changed.select("doc_id", "text", "leaf", "line", F.col("heads").bitwiseXOR(F.col("h").bitwiseXOR(F.coalesce("own_h", nought))).alias("heads"), F.col("tails").bitwiseXOR(F.col("t").bitwiseXOR(F.coalesce("own_t", nought))).alias("tails"))
    same = split_by_filter(lines, "text", bits, inside=False).unionByName(maybe.join(by_text.select("text"), "text", "left_anti").select(*lines.columns))
    return same.unionByName(materialize(changed, "told-lines"))


def leaf_lines(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(leaf, line, tokens) of lines whose leaf may be among those of an id filter."""
    packed = np.packbits(bits)

    def run(batches):
        bits, seen = np.unpackbits(packed).tobytes(), set()
        for batch in batches:
            for _, texts in _texts(batch, 1):
                rows = []
                for text in texts:
                    plain, digits = traits(text)
                    for line in set(text.split("\n")):
                        form = spelled(line, plain, digits)[0]
                        leaf = leaf_of(form) if form else None
                        if form and bits[leaf & (FILTER_BITS - 1)] and (k := (leaf, _hash(form))) not in seen:
                            if len(seen) > 1_000_000:  # what is sent twice is counted once later
                                seen.clear()
                            seen.add(k)
                            rows.append((*k, form))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], ["leaf", "line", "tokens"])

    return docs.mapInArrow(tidy(run), "leaf long, line long, tokens string")


def unlike(pairs: DataFrame, documents: int) -> DataFrame:
    """(leaf, template) of templates with `documents` groups of unlike documents or more; pairs: (leaf, template, heads, tails).

    A group is a connected component of pairs that share heads or tails. Pairs that share neither with another are
    groups of their own; components are computed only of templates that these don't decide.
    """
    at = ["leaf", "template"]
    pairs = materialize(pairs.select(*at, "heads", "tails").distinct(), "pairs")
    by_head = pairs.groupBy(*at, "heads").agg(F.min("tails").alias("tails"), F.max("tails").alias("other"))
    by_tail = pairs.groupBy(*at, "tails").agg(F.min("heads").alias("heads"), F.max("heads").alias("other"))
    # a pair is apart when its heads have its tails only, and its tails its heads only: then both sides give the same row
    ends_ = by_head.select(*at, "heads", F.when(F.col("tails") == F.col("other"), F.col("tails")).alias("tails"), F.lit(1).alias("h"), F.lit(0).alias("t"))
    ends_ = ends_.unionByName(by_tail.select(*at, F.when(F.col("heads") == F.col("other"), F.col("heads")).alias("heads"), "tails", F.lit(0).alias("h"), F.lit(1).alias("t")))
    ends_ = ends_.groupBy(*at, "heads", "tails").agg(F.sum("h").alias("h"), F.sum("t").alias("t"))
    # groups are at least as many as pairs apart, and at most as many as heads or tails
    bounds = ends_.groupBy(*at).agg(F.sum("h").alias("h"), F.sum("t").alias("t"), F.sum(F.col("h") * F.col("t")).alias("n"))
    bounds = materialize(bounds.where((F.col("h") >= documents) & (F.col("t") >= documents)).select(*at, "n"), "bounds")
    sure, open_ = bounds.where(F.col("n") >= documents).select(*at), bounds.where(F.col("n") < documents).select(*at)
    if open_.isEmpty():
        return sure
    node = lambda side: F.xxhash64(*at, F.lit(side), side)
    edges = materialize(pairs.join(open_, at, "left_semi").select(*at, node("heads").alias("a"), node("tails").alias("b")), "edges")
    groups = edges.select(*at, F.col("a").alias("id")).join(connected_components(edges, "groups"), "id").select(*at, "component").distinct()
    return sure.unionByName(groups.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") >= documents).select(*at))


def recurring_lines(docs: DataFrame, lines: DataFrame, documents: int, at_most: tuple[int, int] = (LINES, TOKENS)) -> DataFrame:
    """(k, documents): the lines whose template recurs, each with the number of its own documents."""
    met = materialize(lines.groupBy("leaf", "line", "heads", "tails").agg(F.count("*").alias("documents")), "company")
    per_line = materialize(met.groupBy("leaf", "line").agg(F.sum("documents").alias("documents"), F.count("*").alias("companies")), "per-line")
    leaves = per_line.groupBy("leaf").agg(F.sum("documents").alias("d"), F.count("*").alias("n")).where(F.col("d") >= documents)
    leaves = materialize(leaves.select("leaf", "n"), "leaves")
    single, leaves = leaves.where("n = 1").select("leaf"), leaves.where("n > 1")
    bits = id_filter(leaves.select("leaf"))
    texts = leaf_lines(docs, bits).groupBy("leaf", "line").agg(F.min("tokens").alias("tokens"))
    small = F.col("n") <= at_once(*at_most)
    if leaves.where(~small).isEmpty():
        grown = found_templates(texts.join(per_line.join(leaves.select("leaf"), "leaf", "left_semi"), ["leaf", "line"]))
    else:
        counted = materialize(texts.join(attach_by_key(per_line, leaves, "leaf", "n"), ["leaf", "line"]), "leaf-lines")
        grown = found_templates(counted.where(small)).unionByName(in_rounds(counted.where(~small), *at_most))
    key = F.struct("leaf", "line").alias("k")
    grown = materialize(grown, "templates")
    pairs = attach_by_key(
        met.join(leaves.select("leaf"), "leaf", "left_semi").select(key, "heads", "tails"), grown.select(key, "leaf", "template", F.col("companies").alias("c")), "k", "c"
    ).select("leaf", "template", "heads", "tails")
    alone = met.join(single, "leaf", "left_semi").select("leaf", F.col("line").alias("template"), "heads", "tails")
    found = materialize(unlike(pairs.unionByName(alone), documents), "unlike")
    whole = grown.select("leaf", "line", "template", "documents").unionByName(
        per_line.join(single, "leaf", "left_semi").select("leaf", "line", F.col("line").alias("template"), "documents")
    )
    return whole.join(found, ["leaf", "template"], "left_semi").select(key, "documents")


def clean(docs: DataFrame, documents: int = DOCUMENTS, text: str = "text", key: str = "doc_id", report: bool = False, most: int = RECURRING, at_most: tuple[int, int] = (LINES, TOKENS)) -> DataFrame:
    """The rows of docs, without the lines of recurring templates in their texts.

    With report, (doc_id, n_lines, n_dropped, text) instead. An n_chars column follows the new text. Null texts stay
    null, blank lines stay where they are, a document may be left without text. Rows that repeat a doc_id are counted
    as documents of their own. An empty table stays empty.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lines = told_apart(plain, materialize(line_table(plain), "lines"), documents)
    found = materialize(recurring_lines(plain, lines, documents, at_most), "recurring")
    own, at, ident = docs.columns, docs.columns.index(text), docs.columns.index(key)
    size = own.index("n_chars") if "n_chars" in own else None
    schema, known = docs.schema, None
    if found.limit(most + 1).count() <= most:
        known = np.sort(found.select("k.line").distinct().toArrow()["line"].to_numpy())  # `most` numbers at the most
        rows = docs
    else:
        rows = _with_drops(docs, lines, found, key)

    def run(batches):
        for batch in batches:
            gone = batch.column(len(own)) if known is None else None
            changed, counts = [], []
            for a, texts in _texts(batch, at):
                for i, t in enumerate(texts, a):
                    kept = whole = t.split("\n")
                    drop = np.sort(np.array(gone[i].as_py() or [], np.int64)) if known is None else known
                    if len(drop):
                        plain, digits = traits(t)
                        keys = [_hash(form) if (form := spelled(r, plain, digits)[0]) else None for r in whole]
                        some = np.array([k for k in keys if k is not None], np.int64)
                        place = np.minimum(np.searchsorted(drop, some), len(drop) - 1)
                        bad = set(some[drop[place] == some].tolist())
                        kept = [r for r, k in zip(whole, keys) if k is None or k not in bad] if bad else whole
                    counts.append((len(whole), len(whole) - len(kept)))
                    changed.append("\n".join(kept))
            new = pa.array([c if ok else None for c, ok in zip(changed, batch.column(at).is_valid().to_pylist())], pa.string())
            if report:
                n, d = zip(*counts) if counts else ((), ())
                yield pa.RecordBatch.from_arrays([batch.column(ident).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.int64()), new], ["doc_id", "n_lines", "n_dropped", "text"])
                continue
            columns = [batch.column(i) for i in range(len(own))]
            columns[at] = new
            if size is not None:
                length = pa.array([len(c) if dropped else old for c, (_, dropped), old in zip(changed, counts, batch.column(size).to_pylist())], batch.column(size).type)
                columns[size] = length
            yield pa.RecordBatch.from_arrays(columns, own)

    return rows.mapInArrow(tidy(run), "doc_id long, n_lines long, n_dropped long, text string" if report else schema)


def _with_drops(docs: DataFrame, lines: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """docs with _evigrain_drop, the keys of each row's recurring lines; only rows that may have some are shuffled."""
    hits = attach_by_key(lines.select("doc_id", F.struct("leaf", "line").alias("k")), found, "k", "documents")
    drops = materialize(hits.groupBy("doc_id").agg(F.collect_set("k.line").alias("_evigrain_drop")), "drops")
    bits = id_filter(drops.select("doc_id"))
    touched = split_by_filter(docs, key, bits, inside=True)
    touched = touched.join(drops.withColumnRenamed("doc_id", "_evigrain_id"), F.col(key) == F.col("_evigrain_id"), "left").drop("_evigrain_id")
    return touched.unionByName(split_by_filter(docs, key, bits, inside=False).withColumn("_evigrain_drop", F.lit(None).cast("array<long>")))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """documents without the lines of recurring templates; see clean() for nulls, repeats and empty tables."""
    return clean(over_cores(read_table(spark, sf_dir, "documents")), report=True)
