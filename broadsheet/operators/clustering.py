"""Clusters of a page's blocks: connected components, components with validated merging, and Leiden communities.

A page is one group of a pandas function after one exchange by page; pages are small and self-contained.
"""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import CROSS, HEADLINE_CLASSES, PAGE, SAME

# Fixed values of validation.
MOST_APPENDED, LEAST_TARGET, LEAST_APPEND, MOST_APPEND_GAP, MOST_APPEND_STEPS = 10, 3, 0.85, 0.02, 3
LEAST_SINGLE, LEAST_SHARED = 0.8, 2

_EDGE = {
    "left_block_id": "string", "right_block_id": "string", "prediction": "int", "probability_same_article": "double", "candidate_sources": "string", "column_relation": "string", "class_pair": "string",
    "x_overlap_ratio": "double", "text_similarity": "double", "vertical_gap_norm": "double", "reading_order_delta": "int", "left_class_name": "string", "right_class_name": "string", "pair_id": "string",
}
_MEMBERS = "newspaper_id string, image_id int, page_filename string, block_id string, predicted_cluster_id string, predicted_cluster_size int"
_AUDIT = "pair_id string, cluster_validation_status string, cluster_validation_score double, cluster_validation_reason string"


def cluster_id(block_ids: list[str]) -> str:
    return "pred_" + hashlib.md5("|".join(block_ids).encode()).hexdigest()[:10]


class Components:
    """Disjoint sets that know their members."""

    def __init__(self, items=()):
        self.root: dict[str, str] = {}
        self.members: dict[str, list[str]] = {}
        for i in items:
            self.add(i)

    def add(self, item: str) -> None:
        if item not in self.root:
            self.root[item] = item
            self.members[item] = [item]

    def of(self, item: str) -> list[str]:
        return self.members[self.root[item]]

    def union(self, a: str, b: str) -> None:
        a, b = self.root[a], self.root[b]
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        for item in self.members[b]:
            self.root[item] = a
        self.members[a] += self.members.pop(b)

    def lists(self) -> list[list[str]]:
        return sorted((sorted(m) for m in self.members.values()), key=lambda m: (m[0], len(m)))


#: A block's tokens as joined_tokens() makes them; blocks that have this column need no text.
TOKENS = "cluster_tokens"


def joined_tokens(text: str) -> Column:
    """Tokens, which have no spaces, with spaces between."""
    return F.array_join(X.cluster_tokens(text), " ")


def _rows(blocks: DataFrame, scored: DataFrame, tokens: bool = False) -> DataFrame:
    """Blocks and pairs of pages in one table, so that a page's group has both."""
    # Pairs without text features count as pairs of unlike texts.
    edges = scored.select(*PAGE, *((F.col(c) if c in scored.columns else F.lit(0.0 if c == "text_similarity" else None)).cast(t).alias(c) for c, t in _EDGE.items()), F.lit(None).cast("string").alias("block_id"), F.lit(None).cast("string").alias("tokens"))
    words = F.lit(None)
    if tokens and (TOKENS in blocks.columns or "ocr_text" in blocks.columns):
        words = F.col(TOKENS) if TOKENS in blocks.columns else joined_tokens("ocr_text")
    vertices = blocks.select(*PAGE, *(F.lit(None).cast(t).alias(c) for c, t in _EDGE.items()), "block_id", words.cast("string").alias("tokens"))
    # Tokens are moved as one string, which takes less room than an array, and split where they have come to.
    both = vertices.unionByName(edges).repartition(*PAGE)
    return both.withColumn("tokens", F.when(F.col("tokens") == "", F.array().cast("array<string>")).otherwise(F.split("tokens", " ")))


def _members(page: pd.DataFrame, clusters: list[list[str]]) -> pd.DataFrame:
    keys = page.iloc[0][list(PAGE)].tolist()
    rows = [(*keys, b, cluster_id(c), len(c)) for c in clusters for b in c]
    return pd.DataFrame(rows, columns=[*PAGE, "block_id", "predicted_cluster_id", "predicted_cluster_size"])


def _by_page(blocks: DataFrame, scored: DataFrame, clusters: Callable[[pd.DataFrame, pd.DataFrame], list[list[str]]]) -> DataFrame:
    def run(page: pd.DataFrame) -> pd.DataFrame:
        is_edge = page["left_block_id"].notna()
        return _members(page, clusters(page[~is_edge], page[is_edge]))

    return _rows(blocks, scored).dropna(subset=list(PAGE)).groupBy(*PAGE).applyInPandas(run, _MEMBERS)


def _union_find(vertices: pd.DataFrame, edges: pd.DataFrame) -> list[list[str]]:
    found = Components(vertices["block_id"])
    for left, right, positive in zip(edges["left_block_id"], edges["right_block_id"], edges["prediction"]):
        found.add(left)
        found.add(right)
        if positive == 1:
            found.union(left, right)
    return found.lists()


def union_find(blocks: DataFrame, scored: DataFrame) -> DataFrame:
    """Connected components of positive pairs; every end of a pair is a member, known block or not."""
    return _by_page(blocks, scored, _union_find)


@dataclass(frozen=True)
class Validation:
    strong: float = 0.92
    medium_low: float = 0.5
    medium_high: float = 0.9199
    threshold: float = 0.9


def _number(value) -> float:
    return 0.0 if value is None or value == 0 else float(value)


def _text(value) -> str:
    return "" if value is None or value != value else str(value)


@dataclass(frozen=True)
class Facts:
    """What the rules for a single block and a cluster look at."""

    size: int
    source: str
    relation: str
    classes: str
    overlap: float
    similarity: float
    gap: float
    shared: int
    any_words: bool
    headline: bool

    @property
    def same_column(self) -> bool:
        return self.source == SAME or self.relation == "same_column"


# The rules by topic, in the order of their reasons. Of a topic, the first rule that holds counts: its step, and its reason (# stands for the number of shared words).
BLOCK_RULES = (
    ((lambda f: f.size >= 2, 0.02, "cluster_size>=2"),),
    (
        (lambda f: f.same_column, 0.04, "same_column_support"),
        (lambda f: f.relation == "adjacent_column" and f.overlap > 0.2, 0.02, "adjacent_with_overlap"),
        (lambda f: CROSS in f.source, -0.02, CROSS),
        (lambda f: f.relation == "cross_column", -0.05, "cross_column"),
    ),
    (
        (lambda f: any(c in f.classes for c in ("Section-header__Text", "Text__Section-header")), 0.02, "header_text_class_pair"),
        (lambda f: "Section-header__Section-header" in f.classes, -0.02, "header_header_pair"),
        (lambda f: "Picture" in f.classes, -0.05, "picture_pair"),
    ),
    (
        (lambda f: f.similarity >= 0.2, 0.02, "text_similarity>=0.2"),
        (lambda f: f.similarity == 0, -0.02, "text_similarity_zero"),
    ),
    ((lambda f: f.gap > 0.08, -0.03, "vertical_gap_high"),),
    (
        (lambda f: f.shared >= 3, 0.08, "cluster_ocr_overlap_#"),
        (lambda f: f.shared == 2, 0.05, "cluster_ocr_overlap_#"),
        (lambda f: f.shared == 1, 0.02, "cluster_ocr_overlap_#"),
        (lambda f: f.any_words, -0.04, "cluster_ocr_overlap_#"),
        (lambda f: True, None, "cluster_ocr_unavailable"),
    ),
    ((lambda f: f.headline and f.shared >= LEAST_SHARED, 0.04, "headline_matches_cluster_topic"),),
)


def judge_block(pair: dict, block: str, cluster: list[str], tokens: dict[str, set[str]], threshold: float) -> tuple[bool, float, str]:
    """Whether a single block may join a cluster: the pair's probability with the steps of BLOCK_RULES."""
    own = "left" if pair["left_block_id"] == block else "right"
    shared = sorted(tokens.get(block, set()) & set().union(*(tokens.get(b, set()) for b in cluster)))
    facts = Facts(
        len(cluster), *(_text(pair[c]) for c in ("candidate_sources", "column_relation", "class_pair")), *(_number(pair[c]) for c in ("x_overlap_ratio", "text_similarity", "vertical_gap_norm")),
        len(shared), bool(tokens), pair[f"{own}_class_name"] in HEADLINE_CLASSES,
    )
    p = score = float(pair["probability_same_article"])
    reasons = [f"base_probability={p:.6f}", f"cluster_size={facts.size}"]
    for topic in BLOCK_RULES:
        for holds, step, reason in topic:
            if holds(facts):
                score += step or 0.0
                reasons.append(reason.replace("#", str(facts.shared)) + (f"={step:+.2f}" if step else ""))
                break
    if shared:
        reasons.append("shared_tokens=" + ",".join(shared[:8]))
    reasons.append(f"validation_threshold={threshold:.3f}")
    return p >= LEAST_SINGLE and score >= threshold and len(shared) >= LEAST_SHARED, score, "; ".join(reasons)


def judge_append(pair: dict, appended: list[str], target: list[str], threshold: float) -> tuple[bool, float, str]:
    """Whether a small cluster may be put at the end of a larger one: same column, close by, next in reading order."""
    p = float(pair["probability_same_article"])
    delta = _number(pair["reading_order_delta"])
    steps_away = abs(int(delta)) if delta == delta and delta else 999
    overlap, gap = _number(pair["x_overlap_ratio"]), _number(pair["vertical_gap_norm"])
    sure, same = p >= LEAST_APPEND, _text(pair["candidate_sources"]) == "same_column_window" or _text(pair["column_relation"]) == "same_column"
    aligned, close, next_to = overlap >= 0.8, gap <= MOST_APPEND_GAP, steps_away <= MOST_APPEND_STEPS
    reasons = [f"base_probability={p:.6f}", f"append_cluster_size={len(appended)}", f"target_cluster_size={len(target)}"]
    score = p
    # What holds, the step and reason if it does, and if it does not.
    rules = (
        (sure, 0.02, f"probability>={LEAST_APPEND:.2f}", 0.0, f"probability<{LEAST_APPEND:.2f}"),
        (same, 0.04, "same_column_support", -0.06, "not_same_column"),
        (aligned, 0.03, "x_overlap>=0.8", 0.0, ""),
        (close, 0.03, f"vertical_gap<={MOST_APPEND_GAP:.2f}", -0.05, f"vertical_gap>{MOST_APPEND_GAP:.2f}"),
        (next_to, 0.02, f"reading_order_delta<={MOST_APPEND_STEPS}", -0.03, f"reading_order_delta>{MOST_APPEND_STEPS}"),
    )
    for holds, up, name, down, other in rules:
        step, label = (up, name) if holds else (down, other)
        score += step
        if label:
            reasons.append(f"{label}={step:+.2f}" if step else label)
    reasons.append(f"validation_threshold={threshold:.3f}")
    accepted = sure and len(appended) <= MOST_APPENDED and len(target) >= LEAST_TARGET and same and aligned and close and next_to and score >= threshold
    return accepted, score, "; ".join(reasons)


def _validate(vertices: pd.DataFrame, edges: pd.DataFrame, rule: Validation) -> tuple[list[list[str]], list[tuple]]:
    """(clusters, (pair_id, status, score, reason) of each pair) of a page; the names of the statuses are fixed values. Medium pairs come by falling probability, then by pair."""
    found = Components(vertices["block_id"])
    tokens = {b: set(t) for b, t in zip(vertices["block_id"], vertices["tokens"]) if t is not None}
    audit: dict[str, tuple] = {}
    pairs = edges.to_dict("records")
    for pair in pairs:
        left, right, p = pair["left_block_id"], pair["right_block_id"], pair["probability_same_article"]
        found.add(left)
        found.add(right)
        audit[pair["pair_id"]] = ("not_evaluated", None, "")
        if p >= rule.strong:
            found.union(left, right)
            audit[pair["pair_id"]] = ("strong_accept", p, f"probability>={rule.strong:.3f}; accepted_by_pairwise_threshold")
        elif p < rule.medium_low or p > rule.medium_high:
            audit[pair["pair_id"]] = ("outside_medium_band", None, "")
    medium = [x for x in pairs if rule.medium_low <= x["probability_same_article"] <= rule.medium_high]
    for pair in sorted(medium, key=lambda x: (-x["probability_same_article"], x["pair_id"])):
        left, right, key = pair["left_block_id"], pair["right_block_id"], pair["pair_id"]
        ends = found.of(left), found.of(right)
        if ends[0] is ends[1]:
            audit[key] = ("already_connected", *audit[key][1:])
            continue
        sizes = len(ends[0]), len(ends[1])
        if min(sizes) == 1 and max(sizes) > 1:
            block, cluster = (left, ends[1]) if sizes[0] == 1 else (right, ends[0])
            accepted, score, reason = judge_block(pair, block, cluster, tokens, rule.threshold)
            status = "validated_accept" if accepted else "validated_reject"
        else:
            small, large = ends if sizes[0] <= sizes[1] else ends[::-1]
            accepted, score, reason = judge_append(pair, small, large, rule.threshold)
            status = "validated_append_cluster_accept" if accepted else "rejected_not_singleton_to_cluster"
        audit[key] = (status, score, reason)
        if accepted:
            found.union(left, right)
    return found.lists(), [(k, *v) for k, v in audit.items()]


def validated(blocks: DataFrame, scored: DataFrame, rule: Validation = Validation(), ocr: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, pairs with their validation columns), both from one pass over the pages.

    ocr: False if there is no table of block texts at all; with one, blocks without text have no tokens.
    """

    def run(page: pd.DataFrame) -> pd.DataFrame:
        is_edge = page["left_block_id"].notna()
        clusters, audit = _validate(page[~is_edge], page[is_edge], rule)
        return pd.concat([_members(page, clusters), pd.DataFrame(audit, columns=[c.split()[0] for c in _AUDIT.split(", ")])], ignore_index=True)

    both = _rows(blocks, scored, ocr).dropna(subset=list(PAGE)).groupBy(*PAGE).applyInPandas(run, f"{_MEMBERS}, {_AUDIT}")
    names = [c.split()[0] for c in _AUDIT.split(", ")]
    audit = both.filter("pair_id IS NOT NULL").select(*names)
    return both.filter("pair_id IS NULL").drop(*names), scored.join(audit, "pair_id", "left")


def modularity(edges: dict[tuple[int, int], float], community: list[int], resolution: float) -> float:
    """Quality of a partition under the configuration model, per weight of edges."""
    total = sum(edges.values())
    inside, degree = 0.0, defaultdict(float)
    for (a, b), w in edges.items():
        inside += w * (community[a] == community[b])
        degree[community[a]] += w
        degree[community[b]] += w
    return (inside - resolution * sum(d * d for d in degree.values()) / (4 * total)) / total if total else 0.0


def leiden_partition(n: int, edges: dict[tuple[int, int], float], resolution: float = 1.0, seed: int = 13) -> list[int]:
    """Communities of 0..n-1 after Traag, Waltman and van Eck (2019): local moves, refinement inside communities, aggregation, until nothing moves."""
    rng = random.Random(seed)
    total = sum(edges.values())
    if not total:
        return list(range(n))
    groups = [[i] for i in range(n)]
    weights = dict(edges)
    community = list(range(n))
    while True:
        size = len(groups)
        near: list[dict[int, float]] = [defaultdict(float) for _ in range(size)]
        degree = [0.0] * size
        for (a, b), w in weights.items():
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w

        def move(node: int, part: list[int], mass: dict[int, float], allowed=None) -> int:
            """The community where the node adds most, its own if none adds more."""
            own = part[node]
            mass[own] -= degree[node]
            links: dict[int, float] = defaultdict(float)
            for other, w in near[node].items():
                if allowed is None or allowed(other):
                    links[part[other]] += w

            def gain(c: int) -> float:
                return links.get(c, 0.0) - resolution * degree[node] * mass[c] / (2 * total)

            best = own
            for c in sorted(links):
                if gain(c) > gain(best) + 1e-12:
                    best = c
            mass[best] += degree[node]
            return best

        mass: dict[int, float] = defaultdict(float)
        for node in range(size):
            mass[community[node]] += degree[node]
        queue = list(range(size))
        rng.shuffle(queue)
        waiting = set(queue)
        while queue:
            node = queue.pop(0)
            waiting.discard(node)
            best = move(node, community, mass)
            if best != community[node]:
                community[node] = best
                for other in near[node]:
                    if community[other] != best and other not in waiting:
                        queue.append(other)
                        waiting.add(other)
        refined = list(range(size))
        own_mass: dict[int, float] = defaultdict(float, {i: degree[i] for i in range(size)})
        held = [1] * size
        order = list(range(size))
        rng.shuffle(order)
        for node in order:
            if held[refined[node]] == 1:
                best = move(node, refined, own_mass, lambda o, c=community[node]: community[o] == c)
                held[refined[node]] -= 1
                held[best] += 1
                refined[node] = best
        number = {c: k for k, c in enumerate(dict.fromkeys(refined))}
        if len(number) == size:
            out = [0] * n
            for k, group in enumerate(groups):
                for i in group:
                    out[i] = community[k]
            return out
        merged: list[list[int]] = [[] for _ in number]
        above = [0] * len(number)
        for node in range(size):
            merged[number[refined[node]]] += groups[node]
            above[number[refined[node]]] = community[node]
        joined: dict[tuple[int, int], float] = defaultdict(float)
        for (a, b), w in weights.items():
            x, y = sorted((number[refined[a]], number[refined[b]]))
            joined[x, y] += w
        first: dict[int, int] = {}
        community = [first.setdefault(c, k) for k, c in enumerate(above)]
        groups, weights = merged, dict(joined)


def leiden(blocks: DataFrame, scored: DataFrame, resolution: float = 1.0, seed: int = 13) -> DataFrame:
    """Communities of positive pairs by probability; pairs with an unknown end are left out, a page without pairs has single blocks."""

    def clusters(vertices: pd.DataFrame, edges: pd.DataFrame) -> list[list[str]]:
        ids = sorted(set(vertices["block_id"]))
        number = {b: i for i, b in enumerate(ids)}
        some: dict[tuple[int, int], float] = defaultdict(float)
        for a, b, positive, p in zip(edges["left_block_id"], edges["right_block_id"], edges["prediction"], edges["probability_same_article"]):
            if positive == 1 and a in number and b in number:
                some[tuple(sorted((number[a], number[b])))] += max(float(p), 1e-6)
        found = defaultdict(list)
        for i, c in enumerate(leiden_partition(len(ids), some, resolution, seed)):
            found[c].append(ids[i])
        return sorted(found.values(), key=lambda m: (m[0], len(m)))

    return _by_page(blocks, scored, clusters)


def records(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """Members that are known blocks, with the blocks' attributes; unknown ones count in a cluster's id and size only."""
    own = blocks.select("block_id", "class_name", "confidence", "x1", "y1", "x2", "y2", "page_width", "page_height", "image_path")
    return members.join(own, "block_id").select(*PAGE, "block_id", "predicted_cluster_id", "predicted_cluster_size", *own.columns[1:])


def cluster(blocks: DataFrame, scored: DataFrame, method: str = "union_find", validate: bool = False, rule: Validation = Validation(), resolution: float = 1.0, seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """(cluster records, scored pairs). With `validate` the pairs have the validation columns, which only union_find fills."""
    if method == "union_find" and validate:
        members, scored = validated(blocks, scored, rule)
    elif method == "union_find":
        members = union_find(blocks, scored)
    elif method == "leiden":
        members = leiden(blocks, scored, resolution, seed)
        if validate:
            scored = scored.withColumns({"cluster_validation_status": F.lit("not_evaluated"), "cluster_validation_score": F.lit(None).cast("double"), "cluster_validation_reason": F.lit("")})
    else:
        raise ValueError(f"unsupported clustering method: {method}")
    return records(members, blocks), scored
