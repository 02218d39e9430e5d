"""Problem 6: keep the main body of each page.

A page is a tree: the page, its blocks (runs between blank lines or container lines) and
their lines.  Boosted trees score each line node by its own text (length, case, token
log-odds), its tag and attribute tokens, its depth, the text density of its block and
statistics of its siblings.  Decoding is top-down: a block is kept only where its lines
pay for opening it, and no line is kept in a block that is not.

The trees are trained on a bounded sample in hash order over the whole table:
``SAMPLE_PAGES`` pages that carry markup, where paragraph elements mark the body, each
line once with and once without its tags, and ``SAMPLE_PLAIN`` pages of plain text that
are labelled by a first model and by repetition within their site.  Half of each gives
the token table, the other half the trees.  Everything else covers all pages; scoring
is a narrow Arrow map without any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quarry.llm.boilerplate_lines import host_of
from quarry.llm.boosting import Booster
from quarry.llm.tokens import SPACED, buffers, mix, token_hashes

#: Bound on the labelled pages that the classifier is fitted on.
SAMPLE_PAGES = 1500
#: Bound on the pages without markup that widen its vocabulary.
SAMPLE_PLAIN = 2500
TOKEN_FLOOR = 4
#: A sample line is furniture if it stands in so many pages, and this share of the pages, of its site.
REPEAT_PAGES, REPEAT_SHARE = 3, 0.06
#: Log-odds from which the first model's label of a plain line is believed.
SURE = 2.5
OPEN_BLOCK_COST = 0.5
#: Characters of text that are looked at in one go (bounds a batch's memory).
BATCH_CHARS = 4_000_000

TAGS = ("p", "li", "span", "div", "a", "h1", "h2", "h3", "td", "blockquote")
LIST_MARK = r"^(?:[0-9]+[.)]|[-*•–·>])\s+"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


@dataclass
class TokenWeights:
    """Weights of known token hashes, ascending; others weigh nothing."""

    known: np.ndarray
    value: np.ndarray

    def __post_init__(self):
        # Direct table over the upper 18 bits; of two hashes that meet there the later is forgotten.
        self.slot_hash, self.slot_value = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.float32)
        at = (self.known >> np.uint64(46)).astype(np.int64)
        self.slot_hash[at], self.slot_value[at] = self.known, self.value

    def __reduce__(self):
        return TokenWeights, (self.known, self.value)

    def of(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(46)).astype(np.int64)
        return self.slot_value[at] * (self.slot_hash[at] == h)


NO_WEIGHTS = TokenWeights(np.zeros(0, np.uint64), np.zeros(0, np.float32))


@dataclass
class Lines:
    """Non-blank lines of a batch of pages; all arrays run over them."""

    page: np.ndarray  # index of the page in the batch
    no: np.ndarray  # line number from 1, blank lines counted
    text: pa.Array  # without tags
    columns: list  # features
    block: np.ndarray  # block number, ascending over the batch
    tag: np.ndarray  # index in TAGS, -1 without tag


def _strip_markup(flat: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text without tags; tag index; opening and closing tags; attribute flags; markup-only flag."""
    n = len(flat)
    tag, opened, closed = np.full(n, -1, np.int16), np.zeros(n, np.int32), np.zeros(n, np.int32)
    attr, bare = np.zeros(n, np.int8), np.zeros(n, bool)
    has = pc.fill_null(pc.match_substring_regex(flat, r"<[A-Za-z/!]"), False)
    at = np.flatnonzero(has.to_numpy(zero_copy_only=False))
    if len(at):
        sub = flat.take(pa.array(at))
        closed[at] = pc.count_substring(sub, "</").to_numpy()
        opened[at] = pc.count_substring_regex(sub, r"<[A-Za-z][^<>]*[^/<>]>|<[A-Za-z]>").to_numpy()
        first = pc.struct_field(pc.extract_regex(sub, r"^\s*<(?P<t>[A-Za-z][A-Za-z0-9]*)"), "t")
        first = pc.utf8_lower(pc.fill_null(first, "")).dictionary_encode()
        names = {t: i for i, t in enumerate(TAGS)}
        look = np.array([names.get(t, -1) for t in first.dictionary.to_pylist()] or [-1], np.int16)
        tag[at] = look[first.indices.to_numpy(zero_copy_only=False)]
        attr[at] = pc.match_substring(sub, "class=").to_numpy(zero_copy_only=False).astype(np.int8) + 2 * pc.match_substring(sub, "href=").to_numpy(zero_copy_only=False)
        stripped = pc.replace_substring_regex(sub, r"<[^<>]*>", "")
        bare[at] = pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(stripped)), 0).to_numpy(zero_copy_only=False)
        flat = pc.replace_with_mask(flat, has, stripped)
    amp = pc.fill_null(pc.match_substring(flat, "&"), False)
    if pc.any(amp).as_py():
        sub = flat.filter(amp)
        for a, b in ENTITIES:
            sub = pc.replace_substring(sub, a, b)
        flat = pc.replace_with_mask(flat, amp, sub)
    return flat, tag, opened, closed, attr, bare


def _token_scores(text: pa.Array, weights: TokenWeights) -> list[np.ndarray]:
    """Per text: tokens; mean, least, greatest, first, second and last log-odds; share of known tokens."""
    n = len(text)
    h, owner = token_hashes(text, SPACED)
    flat = weights.of(h)
    size = np.bincount(owner, minlength=n)
    end = size.cumsum()
    some = size > 0
    cols = [np.zeros(n, np.float32) for _ in range(7)]
    if some.any():
        st, last = (end - size)[some], end[some] - 1
        cols[0][some] = np.add.reduceat(flat, st) / size[some]
        cols[1][some] = np.minimum.reduceat(flat, st)
        cols[2][some] = np.maximum.reduceat(flat, st)
        cols[3][some] = flat[st]
        cols[4][some] = flat[np.minimum(st + 1, last)]
        cols[5][some] = flat[last]
        cols[6][some] = np.add.reduceat((flat != 0).astype(np.float32), st) / size[some]
    return [size.astype(np.float32), *cols]


#: Digits, capitals and letters of a byte, counted in three fields of 21 bits.
_COUNTS = np.zeros(256, np.uint64)
_COUNTS[48:58] = 1
_COUNTS[97:123] = 1 << 42
_COUNTS[192:256] = 1 << 42
_COUNTS[65:91] = (1 << 42) + (1 << 21)


def _own_features(text: pa.Array, weights: TokenWeights) -> list[np.ndarray]:
    num = lambda x: x.to_numpy(zero_copy_only=False).astype(np.float32)
    chars = num(pc.utf8_length(text))
    raw, off = buffers(text)
    packed = np.add.reduceat(_COUNTS[raw], off[:-1]) if len(text) else np.zeros(0, np.uint64)
    field = lambda by: ((packed >> np.uint64(by)) & np.uint64(0x1FFFFF)).astype(np.float32)
    digits, upper, letters = field(0), field(21), field(42)
    one = np.maximum(chars, 1)
    item = pc.replace_substring_regex(text, LIST_MARK, "")
    low = pc.utf8_lower(item)
    return [
        chars,
        digits / one,
        upper / np.maximum(letters, 1),
        letters / one,
        num(pc.match_substring_regex(text, r"[.!?…][\"'”’»)\]]*$")),
        num(pc.count_substring(text, " | ")) + num(pc.count_substring(text, "·")) + num(pc.count_substring(text, "»")) + num(pc.count_substring(text, " > ")) + num(pc.count_substring(text, "  ")),
        num(pc.match_substring_regex(text, r"^[-*•–·]\s")),
        num(pc.match_substring_regex(text, r"^[0-9]+[.)]\s")),
        num(pc.match_substring_regex(item, r"^\p{Ll}")),
        num(pc.match_substring_regex(text, r"[%@©\[\]]")),
        num(pc.match_substring(text, ":")),
        num(pc.match_substring(text, "|")),
        num(pc.ends_with(text, "?")),
        *_token_scores(low, weights),
    ]


def _shift(x: np.ndarray, by: int, same: np.ndarray, fill: float) -> np.ndarray:
    """The neighbour's value where it belongs to the same page; ``same[i]``: i and i-1 share a page."""
    out = np.full(len(x), fill, np.float32)
    if by == 1 and len(x) > 1:
        out[1:][same[1:]] = x[:-1][same[1:]]
    if by == -1 and len(x) > 1:
        out[:-1][same[1:]] = x[1:][same[1:]]
    return out


def parse(texts: pa.Array, weights: TokenWeights, use_tags: bool = True) -> Lines:
    """Line nodes of a batch of pages with their features; a null page has no lines."""
    texts = pc.cast(texts, pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    off = split.offsets.to_numpy().astype(np.int64)
    flat = split.values[off[0] : off[-1]]
    off = off - off[0]
    counts = off[1:] - off[:-1]
    page = np.repeat(np.arange(len(counts)), counts)
    no = np.arange(len(flat)) - off[:-1][page] + 1
    flat, tag, opened, closed, attr, bare = _strip_markup(flat)
    flat = pc.utf8_trim_whitespace(flat)
    blank = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    # depth before the line, within its page
    step = (opened - closed).cumsum()
    base = np.concatenate([[0], step])[off[:-1]][page] if len(flat) else step
    depth = np.concatenate([[0], step[:-1]]) - base if len(flat) else step
    # a blank or markup-only line ends a block
    edge = blank.copy()
    edge_count = edge.cumsum()
    live = np.flatnonzero(~blank)
    block_key = edge_count[live] * 1_000_003 + page[live]
    change = np.ones(len(live), bool)
    change[1:] = block_key[1:] != block_key[:-1]
    block = change.cumsum() - 1
    text = flat.take(pa.array(live))
    page, no, tag, attr, depth = page[live], no[live], tag[live], attr[live], depth[live]
    own = _own_features(text, weights)
    n = len(live)
    same = np.zeros(n, bool)
    same[1:] = page[1:] == page[:-1]
    one = np.ones(n, np.float32)
    per_page = np.bincount(page, minlength=len(counts)).astype(np.float32)
    first = np.concatenate([[0], per_page.cumsum()[:-1]])
    rank = np.arange(n) - first[page]
    total = per_page[page]
    blocks = int(block[-1]) + 1 if n else 0
    in_block = np.bincount(block, minlength=blocks).astype(np.float32)
    chars, odds, words, ends = own[0], own[14], own[13], own[4]
    block_chars = np.bincount(block, chars, blocks).astype(np.float32)
    block_odds = (np.bincount(block, odds, blocks) / np.maximum(in_block, 1)).astype(np.float32)
    page_chars = np.bincount(page, chars, len(counts)).astype(np.float32)
    prev_block, next_block = change.astype(np.float32), np.concatenate([change[1:], [True]]).astype(np.float32) if n else one
    cols = [
        *own,
        _shift(words, 1, same, -1), _shift(words, -1, same, -1),
        _shift(odds, 1, same, 0), _shift(odds, -1, same, 0),
        _shift(ends, 1, same, -1), _shift(ends, -1, same, -1),
        prev_block, next_block,
        in_block[block], block_chars[block] / np.maximum(in_block[block], 1), block_odds[block],
        block_chars[block] / np.maximum(page_chars[page], 1),
        rank.astype(np.float32), total - rank.astype(np.float32), (rank / np.maximum(total, 1)).astype(np.float32), total,
    ]
    node = [tag.astype(np.float32), attr.astype(np.float32), depth.astype(np.float32), _shift(tag.astype(np.float32), 1, same, -2), _shift(tag.astype(np.float32), -1, same, -2)]
    cols += node if use_tags else [np.full(n, f, np.float32) for f in (-1, 0, 0, -1, -1)]
    return Lines(page, no, text, cols, block, tag)


@dataclass
class PageModel:
    weights: TokenWeights
    booster: Booster

    def keep(self, lines: Lines) -> np.ndarray:
        """Which lines belong to the main body, after top-down decoding of blocks and lines."""
        n = len(lines.page)
        z = self.booster.decision(lines.columns, n)
        if not n:
            return np.zeros(0, bool)
        gain = np.bincount(lines.block, np.maximum(z, 0))
        return (z > 0) & (gain[lines.block] > OPEN_BLOCK_COST)


def _weak_labels(lines: Lines) -> np.ndarray:
    """Without marked-up pages: full sentences of some length are body."""
    return ((lines.columns[13] >= 12) & (lines.columns[4] > 0)).astype(float)


def _repeated(lines: Lines, site: np.ndarray) -> np.ndarray:
    """Lines that stand in many of the sample pages of their site, digits set aside."""
    masked = pc.replace_substring_regex(pc.replace_substring_regex(pc.utf8_lower(lines.text), r"[0-9]+", "#"), r"\s+", " ").dictionary_encode()
    own = site[lines.page]
    key = own.astype(np.int64) * (len(masked.dictionary) + 1) + masked.indices.to_numpy(zero_copy_only=False)
    _, back = np.unique(key, return_inverse=True)
    if not len(back):
        return np.zeros(0, bool)
    pages = int(lines.page.max()) + 1
    once = np.unique(back.astype(np.int64) * pages + lines.page)
    rows = np.bincount(once // pages, minlength=back.max() + 1)[back]
    return (rows >= REPEAT_PAGES) & (rows >= REPEAT_SHARE * np.bincount(site)[own])


def fit_pages(texts: list[str], plain: list[str] | None = None, sites: list[str] | None = None) -> PageModel:
    """Model from sample pages.

    ``texts`` with paragraph elements carry labels.  ``plain`` pages (``sites``: whose)
    widen the vocabulary: a first model labels their lines where it is sure, and lines that
    repeat within their site are furniture; the second model learns from both.  Pages
    without any paragraph element get labels from sentence length alone.
    """
    marked = [t for t in texts if "<p>" in t or "<p " in t]
    use = marked if len(marked) >= 20 else texts
    half = (use[::2], use[1::2] or use)
    a = parse(pa.array(half[0], pa.large_string()), NO_WEIGHTS)
    label = (a.tag == 0).astype(float) if use is marked else _weak_labels(a)

    def train(weights: TokenWeights, more: list, trees: int = 40) -> PageModel:
        xs, ys = [], []
        for tags in (True, False):
            b = parse(pa.array(half[1], pa.large_string()), weights, tags)
            xs.append(np.stack(b.columns, 1) if len(b.page) else np.zeros((0, len(b.columns))))
            ys.append((b.tag == 0).astype(float) if use is marked else _weak_labels(b))
        return PageModel(weights, Booster(trees=trees).fit(np.concatenate(xs + [x for x, _ in more]), np.concatenate(ys + [y for _, y in more])))

    if not plain:
        return train(token_log_odds([(a.text, label)]), [])
    first = train(token_log_odds([(a.text, label)]), [], trees=15)
    site = np.unique(np.array([x or "" for x in sites]), return_inverse=True)[1]
    c = parse(pa.array(plain, pa.large_string()), first.weights)
    z = first.booster.decision(c.columns, len(c.page))
    rep = _repeated(c, site)
    y = np.where(rep, 0.0, (z > 0).astype(float))
    sure = rep | (np.abs(z) > SURE)
    odd = c.page % 2 == 0
    weights = token_log_odds([(a.text, label), (c.text.filter(pa.array(sure & odd)), y[sure & odd])])
    d = parse(pa.array(plain, pa.large_string()), weights)
    pick = sure & ~odd
    return train(weights, [(np.stack(d.columns, 1)[pick], y[pick])])


def token_log_odds(parts: list[tuple[pa.Array, np.ndarray]]) -> TokenWeights:
    """Log-odds of body against furniture per token, from (lines, labels) pairs."""
    keys, ys = [], []
    nb = nr = 1.0
    base = 0
    for text, label in parts:
        h, owner = token_hashes(pc.utf8_lower(pc.replace_substring_regex(text, LIST_MARK, "")), SPACED)
        keys.append((h, owner + base))
        ys.append(label)
        base += len(label)
        nb, nr = nb + label.sum(), nr + len(label) - label.sum()
    h, line = np.concatenate([k for k, _ in keys]), np.concatenate([k for _, k in keys])
    once = np.unique(mix(h + line.astype(np.uint64)), return_index=True)[1]  # a token counts once per line
    y = np.concatenate(ys)[line[once]]
    known, back = np.unique(h[once], return_inverse=True)
    body, seen = np.bincount(back, y, len(known)), np.bincount(back, minlength=len(known))
    value = np.log((body + 0.5) / nb) - np.log((seen - body + 0.5) / nr)
    often = seen >= TOKEN_FLOOR
    return TokenWeights(known[often], value[often].astype(np.float32))


def fit_from(rows: DataFrame, text: str = "raw_text", url: str = "source_url", provider: str = "provider") -> PageModel:
    """Fit on at most ``SAMPLE_PAGES`` pages with markup and ``SAMPLE_PLAIN`` without, in hash order."""
    t = F.col(text)
    site = F.coalesce(F.nullif(F.substring_index(host_of(F.col(url)), ".", -2), F.lit("")), F.lower(F.col(provider)))
    all_rows = rows.select(t.alias("t"), site.alias("site"), F.xxhash64(t).alias("h"), t.rlike("<p[ >]").alias("marked")).where("t is not null")
    total, tagged = all_rows.agg(F.count("*"), F.coalesce(F.sum(F.col("marked").cast("long")), F.lit(0))).first()

    def sample(rows: DataFrame, there: int, most: int) -> DataFrame:
        # A share of the hashes that holds enough: else every task would send its own ``most`` pages to the driver.
        share = int(1_000_003 * min(1.0, (1.5 * most + 50) / max(there, 1)))
        return rows.where(F.pmod("h", F.lit(1_000_003)) < max(share, 1)).orderBy("h").limit(most)

    marked = [r.t for r in sample(all_rows.where("marked").select("t", "h"), tagged, SAMPLE_PAGES).collect()]
    plain = sample(all_rows.where("not marked").select("t", "site", "h"), total - tagged, SAMPLE_PLAIN).collect()
    texts = [r.t for r in plain]
    return fit_pages(marked or texts, texts, [r.site for r in plain])


def batches_by_chars(batch: pa.RecordBatch, column: str):
    """Slices of a batch with at most ``BATCH_CHARS`` bytes of text each (one row at least)."""
    col = batch.column(column)
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
    group = size.cumsum() // BATCH_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def main_body_lines(rows: DataFrame, model: PageModel, key: str = "id", text: str = "raw_text") -> DataFrame:
    """``(key, line_no, line)`` for each line of the main body, in any order.

    Null, empty and furniture-only pages give no rows; repeated rows give repeated rows.
    """
    def run(it):
        for big in it:
            for batch in batches_by_chars(big, text):
                lines = parse(batch.column(text), model.weights)
                at = np.flatnonzero(model.keep(lines))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(lines.page[at])), pa.array(lines.no[at], pa.int64()), pc.cast(lines.text.take(pa.array(at)), pa.string())], [key, "line_no", "line"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, line_no long, line string")


def body_sets(rows: DataFrame, model: PageModel, width: int = 3, key: str = "id", text: str = "raw_text") -> DataFrame:
    """Shingle sets (``near_duplicates.SETS``) of the pages' main bodies, one per page that has any."""
    from quarry.llm.near_duplicates import SETS, sets_from_tokens

    def run(it):
        for big in it:
            for batch in batches_by_chars(big, text):
                lines = parse(batch.column(text), model.weights)
                at = np.flatnonzero(model.keep(lines))
                yield sets_from_tokens(batch.column(key), lines.text.take(pa.array(at)), lines.page[at], batch.num_rows, width)

    return rows.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, SETS)
