"""HTML extraction by wrapper induction.

The block trees of the pages of a host are aligned by simple tree matching and merged into one wrapper: neighbouring
siblings of one label are one repeated node, and each node counts its pages and the texts that fill it. A text that fills a
node on most pages of the host is template; what varies is content. The main node is found by walking down from the root to
where the varying text is. A page is aligned to its host's wrapper, and its text is what stands in the main node, without
template texts and boilerplate elements.

Wrappers are folded in the tasks that read the pages and merged in levels, so a host with a third of all pages is split.
Pages are dealt to the wrappers by host, hot hosts in pieces.

Defined results: null, empty and text-free pages have an empty text. A null or odd url belongs to the host "". A host with
fewer than MIN_PAGES different pages has no template texts. Rows that repeat a page_id are pages of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import hot_keys, split_join, stored
from trialweave.llm.dom import Element, parse

#: A text is template if it fills a node on this share of the host's pages, and on MIN_PAGES different ones at least.
TEMPLATE, MIN_PAGES = 0.6, 3
#: Texts counted for a node by Misra-Gries: TEXTS and TEXTS_PER_FILL times the texts that a page fills it with on average.
#: So the counts lose at most one part in TEXTS_PER_FILL of the pages, and what was lost is added again where it matters.
TEXTS, TEXTS_PER_FILL = 24, 8
#: Children of two nodes are aligned by simple tree matching; above so many pairs, equal labels at both ends are paired first.
ALIGN_PAIRS = 10_000
#: From this many nodes on, nodes on less than RARE of a wrapper's pages are cut; they can be neither template nor main.
MOST_NODES, RARE = 2_000, 0.01
FAN_IN = 16

# A wrapper node is [label, boiler, pages, mass, texts, children, fills, lost]; texts: digest -> [pages, characters, marks];
# fills: texts that pages fill it with, in all; lost: what Misra-Gries took from each count. Each page sets one of 64 marks by its own digest, so a text that only copies of one page have does not look like a template.


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def wrap(element: Element, mark: int = 1) -> list:
    """The wrapper of one page. Link texts are counted but have no mass."""
    texts: dict[str, list[int]] = {}
    mass, kids = 0, []
    for item in element.items:
        if isinstance(item, tuple):
            texts.setdefault(digest(item[0]), [1, 0 if item[1] else len(item[0]), mark])
            mass += 0 if item[1] else len(item[0])
        else:
            made = wrap(item, mark)
            if kids and kids[-1][0] == made[0] and kids[-1][1] == made[1]:
                _merge_into(kids[-1], made, same_page=True)
            else:
                kids.append(made)
    return [element.label, element.boiler, 1, mass, texts, kids, len(texts), 0]


def _weight(a: list, b: list) -> int:
    """Matched nodes of two nodes of one label, by simple tree matching."""
    return 1 + sum(_weight(a[5][i], b[5][j]) for i, j in _pairs(a, b)) if a[5] and b[5] else 1


def _pairs(a: list, b: list) -> list[tuple[int, int]]:
    """The pairs of children that match: in order, of one label, with the most matched nodes below them."""
    xs, ys = a[5], b[5]
    if [x[0] for x in xs] == [y[0] for y in ys]:
        return [(k, k) for k in range(len(xs))]
    if len(xs) * len(ys) > ALIGN_PAIRS:
        least, head, tail = min(len(xs), len(ys)), 0, 0
        while head < least and xs[head][:2] == ys[head][:2]:
            head += 1
        while tail < least - head and xs[-1 - tail][:2] == ys[-1 - tail][:2]:
            tail += 1
        if head or tail:
            inner = _pairs([*a[:5], xs[head : len(xs) - tail]], [*b[:5], ys[head : len(ys) - tail]])
            ends = [(len(xs) - k, len(ys) - k) for k in range(tail, 0, -1)]
            return [*((k, k) for k in range(head)), *((i + head, j + head) for i, j in inner), *ends]
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    gain = {(i, j): _weight(x, y) for i, x in enumerate(xs) for j, y in enumerate(ys) if x[0] == y[0] and x[1] == y[1]}
    for i in range(1, len(xs) + 1):
        for j in range(1, len(ys) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + gain.get((i - 1, j - 1), 0))
    i, j, pairs = len(xs), len(ys), []
    while i and j:
        if (i - 1, j - 1) in gain and best[i][j] == best[i - 1][j - 1] + gain[i - 1, j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def _merge_into(a: list, b: list, same_page: bool = False) -> None:
    """Adds b, a node of the same label, to a."""
    a[2] = max(a[2], b[2]) if same_page else a[2] + b[2]
    a[3] += b[3]
    texts = a[4]
    for key, (n, chars, marks) in b[4].items():
        if key in texts:
            texts[key] = [max(texts[key][0], n) if same_page else texts[key][0] + n, chars, texts[key][2] | marks]
        else:
            texts[key] = [n, chars, marks]
    a[6] = len(texts) if same_page else a[6] + b[6]
    a[7] += b[7]
    most = TEXTS + TEXTS_PER_FILL * a[6] // max(a[2], 1)
    if len(texts) > 2 * most and not same_page:  # cut to half, so that a merge does not sort each time
        cut = sorted((n for n, _, _ in texts.values()), reverse=True)[most]
        a[4] = {k: [n - cut, chars, marks] for k, (n, chars, marks) in texts.items() if n > cut}
        a[7] += cut
    if not b[5]:
        return
    merged, i, j = [], 0, 0
    for x, y in [*_pairs(a, b), (len(a[5]), len(b[5]))]:
        merged += [*a[5][i:x], *b[5][j:y]]
        if x < len(a[5]) and y < len(b[5]):
            _merge_into(a[5][x], b[5][y], same_page)
            merged.append(a[5][x])
        i, j = x + 1, y + 1
    a[5] = merged


def _nodes(node: list) -> int:
    return 1 + sum(map(_nodes, node[5]))


def _prune(node: list, pages: int) -> None:
    node[5] = [k for k in node[5] if k[2] >= RARE * pages]
    for k in node[5]:
        _prune(k, pages)


def merge(a: list | None, b: list) -> list:
    if a is None:
        return b
    _merge_into(a, b)
    if _nodes(a) > MOST_NODES:
        _prune(a, a[2])
    return a


def _template(node: list, pages: int) -> set[str]:
    return {key for key, (n, _, marks) in node[4].items() if n + node[7] >= TEMPLATE * pages and marks.bit_count() >= MIN_PAGES}


def _varying(node: list, pages: int) -> int:
    """Characters under a node outside template texts, boilerplate and links."""
    if node[1]:
        return 0
    fixed = sum((node[4][k][0] + node[7]) * node[4][k][1] for k in _template(node, pages))
    return max(0, node[3] - fixed) + sum(_varying(k, pages) for k in node[5])


def main_path(wrapper: list) -> list[int]:
    """Child numbers down to the main node: while one child that is no mere run of text holds most of what varies."""
    node, path, pages = wrapper, [], wrapper[2]
    while node[5]:
        masses = [_varying(k, pages) if k[5] else 0 for k in node[5]]
        most = max(masses)
        if 2 * most <= _varying(node, pages):
            break
        path.append(masses.index(most))
        node = node[5][path[-1]]
    return path


class Guide:
    """A wrapper with its main node and the template texts of its nodes, found once for all pages of a host."""

    def __init__(self, wrapper: list) -> None:
        self.wrapper = self.main = wrapper
        for k in main_path(wrapper):
            self.main = self.main[5][k]
        self._fixed: dict[int, set[str]] = {}

    def fixed(self, node: list | None) -> set[str]:
        if node is None:
            return set()
        if id(node) not in self._fixed:
            self._fixed[id(node)] = _template(node, self.wrapper[2])
        return self._fixed[id(node)]


def main_text(page: Element, guide: Guide) -> str:
    """Blocks of the page's part in the main node, joined by blank lines."""
    blocks: list[str] = []
    met, todo = False, [(page, guide.wrapper, guide.main is guide.wrapper)]
    while todo:
        item, node, inside = todo.pop()
        if isinstance(item, str):
            blocks.append(item)
            continue
        met = met or inside
        if item.boiler:
            continue
        runs = _runs(item)
        matched = {j: node[5][i] for i, j in _pairs(node, wrap(item))} if node is not None and node[5] and runs else {}
        of = {id(e): matched.get(j) for j, run in enumerate(runs) for e in run}
        fixed = guide.fixed(node)
        below = [(i, of[id(i)], inside or of[id(i)] is guide.main) if isinstance(i, Element) else (i[0], None, True) for i in item.items if isinstance(i, Element) or (inside and (not fixed or digest(i[0]) not in fixed))]
        todo.extend(reversed(below))
    return "\n\n".join(blocks) if met else main_text(page, Guide(wrap(page)))  # a page of another make is its own wrapper


def _runs(element: Element) -> list[list[Element]]:
    """Its children in runs of one label, as `wrap` folds them."""
    runs: list[list[Element]] = []
    for item in element.items:
        if isinstance(item, Element):
            if runs and runs[-1][0].label == item.label and runs[-1][0].boiler == item.boiler:
                runs[-1].append(item)
            else:
                runs.append([item])
    return runs


def host_of(url: str | Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _fold_pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of a task's pages; the task's number places it in the reduction tree."""
    held: dict[str, list] = {}
    seen: set[tuple[str, str]] = set()  # of the pages of one task
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            key = (host, digest(page or ""))
            if page and key not in seen:
                seen.add(key)
                held[host] = merge(held.get(host), wrap(parse(page), 1 << int(key[1][:2], 16) % 64))
    part = TaskContext.get().partitionId()
    made = [pa.array(held.keys(), pa.string()), pa.array([part] * len(held), pa.int64()), pa.array([json.dumps(w) for w in held.values()], pa.string())]
    yield pa.RecordBatch.from_arrays(made, ["host", "part", "wrapper"])


def _merge_group(table: pa.Table) -> pa.Table:
    held = None
    rows = table.sort_by([("part", "ascending")])
    for text in rows.column("wrapper"):
        held = merge(held, json.loads(text.as_py()))
    part = rows.column("part")[0].as_py() // FAN_IN
    return pa.table({"host": rows.column("host").slice(0, 1), "part": pa.array([part], pa.int64()), "wrapper": pa.array([json.dumps(held)])})


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper, for the columns host and html."""
    level = stored(pages.select("host", "html").mapInArrow(_fold_pages, "host string, part long, wrapper string"))
    most = level.agg(F.max("part")).first()[0] or 0
    while True:
        level = level.groupBy("host", F.floor(F.col("part") / FAN_IN).alias("_group")).applyInArrow(_merge_group, "host string, part long, wrapper string")
        most //= FAN_IN
        if not most:
            return stored(level.select("host", "wrapper"))
        level = stored(level)


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    source = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    hosts = stored(source.groupBy("host").agg(F.count("*").alias("n")))
    joined = split_join(source, wrappers(source), "host", hot_keys(hosts, "host"), "html")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, guide = None, None
        for batch in batches:
            texts = []
            for text, own in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if own != last:
                    last, guide = own, own and Guide(json.loads(own))
                texts.append(main_text(parse(text), guide) if text and guide else "")
            made = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["page_id", "url", "text", "n_chars"])

    kinds = dict(source.dtypes)
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
