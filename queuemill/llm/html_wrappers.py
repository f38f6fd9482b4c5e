"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

1. Each page becomes a *skeleton*: its elements in order, with runs of equal neighbours, or of equal groups
   of neighbours, folded into repeated groups. Equal skeletons of a host are counted before anything meets in
   one place, so a host with a third of all pages costs no more than its different skeletons.
2. Skeletons of a host are aligned one after another, in bundles of ``BUNDLE``, until one is left: elements of
   one name are merged, elements that the other side lacks become optional, differing numbers become
   repetition. The result is the host's wrapper, with ``#text`` for slots and ``#same`` for template texts.
3. Texts are slots: a place whose text differs between pages carries data, one whose text never does is part of
   the template. The wrapper's main region is its ``article`` or ``main`` if it has one, else the element that
   holds most of the slots' text.
4. A page's text is that of the main region where its wrapper has it, without parts that stand apart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.llm.html_tree import INLINE, Node, blocks, parse
from queuemill.session import stored

#: Skeletons that one task aligns into one.
BUNDLE = 128
#: Bytes of wrappers' main paths that may be broadcast; more are joined by host.
BROADCAST_BYTES = 32 << 20
#: Share of the slots' text that a region must hold to be entered.
MOST = 0.6

#: Wrappers tell elements apart down to this depth; the text of deeper ones counts to the element there, none is lost.
DEPTH = 150

# A skeleton node: [name, repeated, optional, children]. A group of neighbours that repeats has the name "()".


def _same_shape(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] != "()" or [c[0] for c in a[3]] == [c[0] for c in b[3]])


def align(a: list, b: list) -> list:
    """Two sequences as one: common nodes merged, others optional (longest common subsequence)."""
    if [x[0] for x in a] == [y[0] for y in b] and all(map(_same_shape, a, b)):
        return [merge(x, y) for x, y in zip(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            skip = max(best[i + 1][j], best[i][j + 1])
            best[i][j] = max(skip, best[i + 1][j + 1] + 1) if _same_shape(a[i], b[j]) else skip
    found, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if _same_shape(a[i], b[j]) and best[i][j] == best[i + 1][j + 1] + 1:
            found.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            found.append([a[i][0], a[i][1], 1, a[i][3]])
            i += 1
        else:
            found.append([b[j][0], b[j][1], 1, b[j][3]])
            j += 1
    return found + [[x[0], x[1], 1, x[3]] for x in a[i:] + b[j:]]


def merge(a: list, b: list) -> list:
    return [a[0], a[1] | b[1], a[2] | b[2], align(a[3], b[3])]


def fold(nodes: list) -> list:
    """Neighbours, then groups of two to four neighbours, that repeat become one repeated node."""
    for size in range(1, 5):
        found: list = []
        i = 0
        while i < len(nodes):
            group = nodes[i : i + size]
            j = i + size
            times = 1
            while len(group) == size and j + size <= len(nodes) and all(map(_same_shape, group, nodes[j : j + size])):
                group = [merge(x, y) for x, y in zip(group, nodes[j : j + size])]
                j, times = j + size, times + 1
            if times == 1:
                found.append(nodes[i])
                i += 1
            else:
                if size == 1:
                    found.append([group[0][0], 1, group[0][2], group[0][3]])
                else:
                    found.append(["()", 1, 0, group])
                i = j
        nodes = found
    return nodes


def skeleton(page: Node) -> list:
    """Children of a page as skeleton nodes, without inline elements and parts that stand apart, ``DEPTH`` levels deep."""

    def inner(node: Node, depth: int) -> list:
        found = []
        for item in node.items:
            if isinstance(item, str) or item.tag in INLINE or item.tag == "br":
                continue
            found.append([item.name, 0, 0, [] if item.apart or depth >= DEPTH else inner(item, depth + 1)])
        return fold(found)

    return inner(page, 1)


def slots(page: Node) -> dict[str, list[str]]:
    """Texts by path of names, own text of each element only; below ``DEPTH`` levels that of all it holds."""
    found: dict[str, list[str]] = {}
    todo = [(page, "", 0)]
    while todo:
        node, path, depth = todo.pop()
        if depth >= DEPTH:
            text = " ".join(" ".join(blocks(node)).split())
            if text:
                found.setdefault(path, []).append(text)
            continue
        own = []
        for item in node.items:
            if isinstance(item, str):
                own.append(item)
            elif item.tag in INLINE:
                own += blocks(item)
            elif not item.apart:
                todo.append((item, f"{path}/{item.name}", depth + 1))
        text = " ".join(" ".join(own).split())
        if text:
            found.setdefault(path, []).append(text)
    return found


def wrapper_text(nodes: list, texts: dict[str, str], path: str = "") -> str:
    """The wrapper as a regular expression over tags; ``texts`` has what stands for the text at a path."""
    parts = []
    for name, repeated, optional, inner in nodes:
        here = path if name == "()" else f"{path}/{name}"
        body = wrapper_text(inner, texts, here)
        if name != "()":
            body = f"<{name}>{texts.get(here, '')}{body}</{name.split('.')[0]}>"
        sign = "*" if repeated and optional else "+" if repeated else "?" if optional else ""
        parts.append(f"({body}){sign}" if sign else body)
    return "".join(parts)


def main_path(nodes: list, chars: dict[str, int]) -> str:
    """Path of the main region: ``article`` or ``main`` with most text, else the deepest element that still holds most of it."""

    def weight(path: str) -> int:
        return sum(n for p, n in chars.items() if p == path or p.startswith(path + "/"))

    paths: list[str] = []

    def walk(level: list, path: str) -> None:
        for name, _, _, inner in level:
            here = path if name == "()" else f"{path}/{name}"
            if name != "()":
                paths.append(here)
            walk(inner, here)

    walk(nodes, "")
    for tag in ("article", "main"):
        named = [p for p in paths if p.rsplit("/", 1)[-1].split(".")[0] == tag]
        if named and (best := max(named, key=weight)) and weight(best):
            return best
    here = ""
    while True:
        below = {p for p in paths if p.startswith(here + "/") and "/" not in p[len(here) + 1 :]}
        best = max(sorted(below), key=weight, default=None)
        if best is None or weight(best) < MOST * max(1, weight(here)) or chars.get(best, 0) > weight(best) / 2:
            return here
        here = best


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_SKELETONS = "host string, skeleton string, path string, text_hash bigint, chars bigint"


def page_parts(pages: DataFrame) -> DataFrame:
    """Of each page: one row with its skeleton, and one for each slot with the hash and length of its text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = parse(source)
                rows.append((host, json.dumps(skeleton(page), separators=(",", ":")), None, None, None))
                for path, texts in slots(page).items():
                    text = "\n".join(texts)
                    rows.append((host, None, path, xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1, len(text)))
            names = ["host", "skeleton", "path", "text_hash", "chars"]
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    known = pages.filter("html is not null").select(host_of(F.col("url")).alias("host"), "html")
    return known.mapInArrow(read, _SKELETONS)


def _align_all(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["skeleton"].to_pylist(), table["pages"].to_pylist()), key=lambda r: (-r[1], r[0]))
    whole: list = json.loads(rows[0][0])
    for text, _ in rows[1:]:
        whole = fold(align(whole, json.loads(text)))
    return pa.table(
        {"host": [table["host"][0].as_py()], "skeleton": [json.dumps(whole, separators=(",", ":"))],
         "pages": pa.array([sum(n for _, n in rows)], pa.int64())}
    )


def _choose(table: pa.Table) -> pa.Table:
    nodes = json.loads(table["skeleton"][0].as_py())
    found = [s.as_py() for s in table["slots"]][0] or []
    chars = {s["path"]: s["chars"] for s in found}
    constant = {s["path"] for s in found if s["same"]}
    varying = {p: n for p, n in chars.items() if p not in constant}
    return pa.table(
        {
            "host": table["host"],
            "pages": table["pages"],
            "wrapper": [wrapper_text(nodes, {p: "#same" if p in constant else "#text" for p in chars})],
            "main_path": [main_path(nodes, varying if any(varying.values()) else chars)],
        }
    )


def wrappers(pages: DataFrame, bundle: int = BUNDLE) -> DataFrame:
    """One row per host: host, pages, wrapper (text), main_path. Pages without html have no part in it."""
    parts = stored(page_parts(pages), "html-parts")
    rows = parts.filter("skeleton is not null").groupBy("host", "skeleton").agg(F.count("*").alias("pages"))
    rows = stored(rows, "html-skeletons")
    while True:
        most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 1
        if most == 1:
            break
        salt = F.pmod(F.xxhash64("skeleton"), F.lit(-(-most // bundle)))
        grouped = rows.withColumn("bundle", salt).groupBy("host", "bundle")
        rows = stored(grouped.applyInArrow(_align_all, "host string, skeleton string, pages bigint"), "html-skeletons")
    places = parts.filter("path is not null").groupBy("host", "path").agg(
        F.sum("chars").alias("chars"),
        ((F.min("text_hash") == F.max("text_hash")) & (F.count("*") > 1)).alias("same"),
    )
    by_host = places.groupBy("host").agg(F.collect_list(F.struct("path", "chars", "same")).alias("slots"))
    return rows.join(by_host, "host", "left").groupBy("host").applyInArrow(
        _choose, "host string, pages bigint, wrapper string, main_path string"
    )


def find(page: Node, path: str) -> list[Node]:
    """Elements of a page at a path of names."""
    nodes = [page]
    for name in path.split("/")[1:]:
        nodes = [item for node in nodes for item in node.items if isinstance(item, Node) and item.name == name]
    return nodes


def page_text(source: str | None, path: str | None) -> str:
    """Main text of a page by its wrapper's main path; a page without that region is read by its own."""
    if not source:
        return ""
    page = parse(source)
    regions = find(page, path) if path else []
    if not any(blocks(node) for node in regions):
        chars = {p: sum(map(len, t)) for p, t in slots(page).items()}
        own = main_path(skeleton(page), chars)
        regions = find(page, own) if own else [page]
    return "\n".join(block for node in regions for block in blocks(node))


def extract(pages: DataFrame, bundle: int = BUNDLE) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text ("" if none), n_chars (code points).

    NULL html gives an empty text; a NULL or odd url belongs to the host "". Repeated rows give equal rows.
    """
    chosen = stored(wrappers(pages, bundle).select("host", "main_path"), "html-wrappers")
    size = chosen.agg(F.sum(F.length("host") + F.length("main_path") + 64)).first()[0] or 0
    known = F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(*x) for x in zip(batch.column("html").to_pylist(), batch.column("main_path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(known, "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "main_path").mapInArrow(
        read, f"page_id {kind}, url string, text string, n_chars bigint"
    )
