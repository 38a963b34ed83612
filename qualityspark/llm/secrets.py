"""Secret scan: candidates by pattern, false positives removed by a random forest.

Everything is a DataFrame expression on a document's own row: text is cut into
candidates and what stands between, each candidate becomes small whole-number
features (length, character transitions, dictionary coverage, path, words
beside it), and the forest is a nested CASE over these. The forest is grown
from labelled findings by histograms that Spark counts, one aggregation per
level for all trees; the driver sees counts only. Every fourth tree sees nothing
of a credential's name before a value, so that what is learned where such a
name tells the label also serves where there is none.

A text is split once, and only if it has a digit, an equals sign or a colon,
without which there is no candidate. Its parts (``dissect``) can be written, so
that training, scanning and masking share one pass over the texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityspark.functions.scalars import let
from qualityspark.llm.common import cut_lineage

_CLASS = r"[A-Za-z0-9_+/-]"
#: A run of eight or more such characters, one of them a digit, and its padding; only tried where a run begins.
CANDIDATE = rf"(?<!{_CLASS})(?=[A-Za-z_+/-]*+[0-9]){_CLASS}{{8,}}(?:={{1,2}}(?![A-Za-z0-9_+/=-]))?"
MASK = "[SECRET]"

#: Characters before and behind a candidate that count as beside it.
BEFORE, BEHIND = 48, 24
BINS, TREES, DEPTH = 16, 16, 4
#: Labelled findings to learn from, at most; a score from here on is a secret.
SAMPLE, THRESHOLD = 4000, 0.5

CREDENTIAL = r"(?i)(token|secret|passw|pwd|api[_-]?key|access[_-]?key|private|auth|bearer|credential)"
#: What stands between a credential's name and its value: an assignment, blanks and a quote.
_ASSIGN, _QUOTE = r"[ \t]{0,8}[:=]{1,3}>?[ \t]{0,8}", r"""["']?"""
#: Eight or more characters other than blanks behind a name with a credential's word in it and an assignment, with or without
#: digits: up to its quote, or else without the punctuation behind it. Java only, as the name is looked back at.
VALUE = (
    rf"""(?<=[=:>"' \t])(?=[^\s=:>])(?<=[=:>][ \t]{{0,8}}{_QUOTE})(?<={CREDENTIAL}[A-Za-z0-9_.-]{{0,32}}{_QUOTE}{_ASSIGN}{_QUOTE})(?!//)"""
    r"""(?:(?<=")[^\s"]{8,}|(?<=')[^\s']{8,}|(?<!["'])[^\s"']{7,}[^\s"',;.)\]}])"""
)
FOUND = f"(?:{VALUE})|(?:{CANDIDATE})"
#: What every candidate has or stands behind.
ANY = "[0-9=:]"
#: Values whose shape alone tells that they are keys, by the issuers' published formats.
KNOWN = (
    r"^((AKIA|ASIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[pousr]_[0-9A-Za-z]{36}|github_pat_[0-9A-Za-z_]{22,}|glpat-[0-9A-Za-z_-]{20}"
    r"|xox[abeoprs]-[0-9A-Za-z-]{10,}|[rs]k_(live|test)_[0-9A-Za-z]{16,}|SG\.[0-9A-Za-z_-]{22}|npm_[0-9A-Za-z]{36}|hf_[0-9A-Za-z]{34})"
)
#: Digests in hex as such: of content, not of secrets, unless a credential's name says so.
DIGEST = "^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{128})$"
BENIGN = r"(?i)(example|sample|test|dummy|commit|sha\d*|md5|hash|checksum|uuid|phone|call|tel\b|card|order|invoice|version|page)"
ASSIGNED = r"""(=|:|=>)\s*["']?$"""
#: Words that make up names rather than keys.
DICTIONARY = (
    "access account address admin alpha api app auth base beta build cache class client cloud code commit config count data date default dev "
    "document example field file final group hash host image index info input item key line link list local log main master message model "
    "module name network node number object order output page part password path phone port prod project proxy public query release report "
    "request response result root sample secret server service session size source stage start state string system table task temp test text "
    "time title token type update upload user value version view week word year"
).split()
COMMON_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng le se ha as ou io ve co me de hi ri ro ic ne ea ra ce".split()


def _running(lengths: Column, most: int = 256) -> Column:
    """What stands before each of ``lengths``, as sums; blocks of ``most`` first, so the work does not grow with the square."""
    zero = F.lit(0).cast("long")
    add = lambda n, x: n + x
    begin = lambda numbers: F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / most)), lambda k: (k * most).cast("int"))

    def before(each: Column) -> Column:
        blocks = F.transform(begin(each), lambda k: F.aggregate(F.slice(each, k + 1, F.lit(most)), zero, add))

        def placed(sums: Column) -> Column:
            ahead = F.transform(sums, lambda _, k: F.aggregate(F.slice(sums, F.lit(1), k), zero, add))

            def inner(known: Column) -> Column:
                block = lambda i: F.floor(i / most).cast("int")
                own = lambda i: F.aggregate(F.slice(each, block(i) * most + 1, i % most), zero, add)
                return F.transform(each, lambda _, i: F.get(known, block(i)) + own(i))

            return let(ahead, inner)

        return let(blocks, placed)

    return let(lengths, before)


def dissect(text: Column, path: Column | None = None) -> Column:
    """A text as ``between``, what stands between candidates, and ``found``: ``value, start, before, behind, path, features`` of each.

    Candidates are values of ``VALUE`` and runs of ``CANDIDATE``. A run without a
    digit, or one that other characters break into parts of fewer than eight, is
    found only where it is assigned to a credential's name. A candidate that is
    the name of the next one's assignment belongs to what stands before it.
    ``start`` counts code points from 0. A null text is an empty one.
    """
    path = F.lit("") if path is None else F.coalesce(path.cast("string"), F.lit(""))

    def cut(text: Column) -> Column:
        some = text.rlike(ANY)
        found = F.when(some, F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.when(some, F.split(text, FOUND, -1)).otherwise(F.array(text)).alias("between"), found.alias("found"))

    def described(parts: Column) -> Column:
        between, found = parts["between"], parts["found"]
        lengths = F.transform(found, lambda v, i: (F.length(F.get(between, i)) + F.length(v)).cast("long"))

        def before(i: Column) -> Column:
            own = F.get(between, i)
            name = F.concat(F.right(F.get(between, i - 1), F.lit(BEFORE)), F.get(found, i - 1))
            return F.right(F.when((i > 0) & own.rlike(rf"^{_QUOTE}{_ASSIGN}{_QUOTE}$"), F.concat(name, own)).otherwise(own), F.lit(BEFORE))

        def one(ahead: Column, i: Column) -> Column:
            plain = F.struct(
                F.get(found, i).alias("value"),
                (ahead + F.length(F.get(between, i))).alias("start"),
                before(i).alias("before"),
                F.left(F.get(between, i + 1), F.lit(BEHIND)).alias("behind"),
                path.alias("path"),
            )
            return let(plain, lambda c: c.withField("features", features(c)))

        none = F.array().cast("array<struct<value:string,start:bigint,before:string,behind:string,path:string,features:array<int>>>")
        described = F.when(F.size(found) > 0, F.transform(_running(lengths), one)).otherwise(none)
        return F.struct(between.alias("between"), described.alias("found"))

    return let(F.coalesce(text, F.lit("")), lambda text: let(cut(text), described))


def candidates(text: Column, path: Column | None = None) -> tuple[Column, Column]:
    """``between`` and ``found`` of ``dissect``, each by itself."""
    parts = dissect(text, path)
    return parts["between"], parts["found"]


def _share(part: Column, whole: Column) -> Column:
    return F.least(F.floor(part * BINS / F.greatest(whole, F.lit(1))), F.lit(BINS - 1)).cast("int")


def features(c: Column) -> Column:
    """Whole numbers from 0 to ``BINS - 1`` for one candidate."""
    v, before, behind = c["value"], c["before"], c["behind"]
    n = F.length(v)
    count = lambda pattern: F.regexp_count(v, F.lit(pattern))
    runs = count("[a-z]+") + count("[A-Z]+") + count("[0-9]+") + count("[^A-Za-z0-9]+")
    known = n - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    beside = F.concat(before, F.lit(" "), behind)
    marks = F.when(before.rlike(ASSIGNED), 2).otherwise(0) + F.when(before.rlike("[\"']$"), 1).otherwise(0)
    place = (
        F.when(c["path"].rlike(r"(?i)\.(env|pem|key|p12|pfx)$"), 3)
        .when(c["path"].rlike("(?i)(test|spec|mock|fixture|example|doc)"), 2)
        .when(c["path"].rlike(r"(?i)\.(ya?ml|json|toml|ini|cfg|conf|properties)$"), 1)
        .otherwise(0)
    )
    return F.array(
        F.least(F.floor(n / 4), F.lit(BINS - 1)).cast("int"),
        _share(runs - 1, n),
        _share(count("(?i)(?=" + "|".join(COMMON_PAIRS) + ")"), n),
        _share(count("[aeiouAEIOU]+"), n),
        _share(count("[0-9]"), n),
        _share(count("[A-Z]"), n),
        _share(count("[0-9a-fA-F]"), n),
        _share(F.size(F.array_distinct(F.split(v, ""))), n),
        _share(known, n),
        F.least(F.regexp_count(before, F.lit(CREDENTIAL)), F.lit(3)),
        marks,
        F.when(behind.rlike("^[\"']"), 1).otherwise(0),
        F.least(F.regexp_count(beside, F.lit(BENIGN)), F.lit(3)),
        place,
    )


N_FEATURES = 14
#: A credential's name and an assignment before a value.
HIDDEN = (9, 10)


def evident_label(c: Column) -> Column:
    """1 for a key of a known shape and for a value assigned to a credential's name, 0 for other digests in hex, plain numbers and
    numbered names, else null, as for a plain word with such a name."""
    named = c["before"].rlike(CREDENTIAL + r"""s?["']?\s*""" + ASSIGNED)
    plain = c["value"].rlike(r"^[-+0-9]+$") | c["value"].rlike(r"^[A-Za-z]+([-_][A-Za-z]+)*[-_]?[0-9]{1,4}$") | c["value"].rlike(DIGEST)
    return F.when(c["value"].rlike(KNOWN) | (named & ~c["value"].rlike("^[A-Za-z]?[a-z]+$")), 1).when(plain, 0)


def labelled(found: DataFrame, found_col: str = "found") -> DataFrame:
    """``features, label, value`` of the candidates in ``found_col`` whose shape or context tells what they are."""
    each = found.select(F.explode(found_col).alias("c")).select("c", evident_label(F.col("c")).alias("label")).filter("label IS NOT NULL")
    return each.select("c.features", "label", "c.value")


def labelled_findings(docs: DataFrame, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``features, label, value`` of the evident candidates of ``docs``; ``path_col`` is None if there is no path."""
    return labelled(docs.select(dissect(docs[text_col], docs[path_col] if path_col else None)["found"].alias("found")))


@dataclass
class Node:
    """A leaf's share of secrets, or a split: features up to ``cut`` go left."""

    share: float
    feature: int | None = None
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Forest:
    trees: list[Node] = field(default_factory=list)

    def score(self, f: Column) -> Column:
        """Mean share over trees; one half if there was nothing to learn from."""
        if not self.trees:
            return F.lit(0.5)
        return sum((_case(t, f, lambda leaf: F.lit(leaf.share)) for t in self.trees[1:]), _case(self.trees[0], f, lambda leaf: F.lit(leaf.share))) / len(self.trees)

    def score_row(self, f: list[int]) -> float:
        """The same for one row of features, in Python."""
        total = 0.0
        for node in self.trees:
            while node.feature is not None:
                node = node.left if f[node.feature] <= node.cut else node.right
            total += node.share
        return total / len(self.trees) if self.trees else 0.5


def _case(node: Node, f: Column, leaf) -> Column:
    if node.feature is None:
        return leaf(node)
    return F.when(F.get(f, F.lit(node.feature)) <= node.cut, _case(node.left, f, leaf)).otherwise(_case(node.right, f, leaf))


def _leaves(node: Node, out: list[Node]) -> list[Node]:
    if node.feature is None:
        out.append(node)
        return out
    return _leaves(node.right, _leaves(node.left, out))


def grow(findings: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """A forest from labelled findings (``features, label, value``, from wherever), at most ``sample`` distinct ones of either label.

    Findings that repeat count once, so that copied texts do not crowd out others.
    Each tree weighs rows by a draw from their hash, and each of its nodes looks
    at about half of the features, those of every fourth tree never at
    ``HIDDEN`` ones, so the same findings give the same forest however they are
    spread. Findings of one label only give that label's score to
    all; without findings the forest is empty, and its score one half.
    """
    key = F.xxhash64("value", "features")
    # Written, as both labels are chosen from it.
    distinct = cut_lineage(findings.select("value", "features", "label").distinct())
    chosen = [distinct.filter(F.col("label") == c).withColumn("key", key).orderBy("key", "value").limit(sample) for c in (0, 1)]
    draw = F.pmod(F.xxhash64("key", "tree"), F.lit(1000))
    weight = F.when(draw < 368, 0).when(draw < 736, 1).when(draw < 920, 2).otherwise(3)
    spread = chosen[0].unionByName(chosen[1]).select("key", "features", "label", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = cut_lineage(spread.withColumn("w", weight).groupBy("tree", "features", "label").agg(F.sum("w").alias("w")).filter("w > 0"))
    both = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("w").alias("n")).collect()}
    if not both:
        return Forest()
    forest = Forest([Node(both.get(1, 0) / sum(both.values())) for _ in range(trees)])
    for level in range(depth):
        leaves = [_leaves(t, []) for t in forest.trees]
        place = F.lit(None).cast("int")
        for t, own in enumerate(leaves):
            at = {id(leaf): i for i, leaf in enumerate(own)}
            place = F.when(F.col("tree") == t, _case(forest.trees[t], F.col("features"), lambda leaf, at=at: F.lit(at[id(leaf)]))).otherwise(place)
        each = rows.select("tree", place.alias("leaf"), "label", "w", F.posexplode("features").alias("feature", "bin"))
        counts: dict = {}
        for r in each.groupBy("tree", "leaf", "feature", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("hits")).collect():
            counts.setdefault((r["tree"], r["leaf"]), {}).setdefault(r["feature"], []).append((r["bin"], r["n"], r["hits"]))
        for (tree, leaf), by_feature in counts.items():
            seen = {k: v for k, v in by_feature.items() if _drawn(tree, level, leaf, k) and not (tree % 4 == 3 and k in HIDDEN)}
            _split(leaves[tree][leaf], seen)
    return forest


def _drawn(*place: int) -> bool:
    """Whether a node looks at a feature: even odds, the same in every run."""
    return hashlib.blake2b(repr(place).encode(), digest_size=1).digest()[0] % 2 == 0


def _split(leaf: Node, by_feature: dict[int, list[tuple[int, int, int]]]) -> None:
    """Split a leaf where the impurity falls most; ties go to the lower feature and cut."""
    best = (1e-9, None, None, 0.0, 0.0)
    impurity = lambda n, hits: hits * (n - hits) / n
    for feature, bins in sorted(by_feature.items()):
        n, hits = sum(b[1] for b in bins), sum(b[2] for b in bins)
        low_n = low_hits = 0
        for cut, more, found in sorted(bins)[:-1]:
            low_n, low_hits = low_n + more, low_hits + found
            gain = impurity(n, hits) - impurity(low_n, low_hits) - impurity(n - low_n, hits - low_hits)
            if gain > best[0]:
                best = (gain, feature, cut, low_hits / low_n, (hits - low_hits) / (n - low_n))
    if best[1] is not None:
        leaf.feature, leaf.cut, leaf.left, leaf.right = best[1], best[2], Node(best[3]), Node(best[4])


def judged(found: Column, forest: Forest, threshold: float = THRESHOLD) -> Column:
    """``start, length, value, score, is_secret`` of every candidate in ``found``."""

    def one(c: Column) -> Column:
        score = let(c["features"], forest.score)
        plain = F.struct(c["start"].alias("start"), F.length(c["value"]).cast("long").alias("length"), c["value"].alias("value"), score.alias("score"))
        return let(plain, lambda s: s.withField("is_secret", s["score"] >= threshold))

    return F.transform(found, one)


def masked(parts: Column, forest: Forest, threshold: float = THRESHOLD, mask: str = MASK) -> Column:
    """The text of ``parts`` with every secret replaced by ``mask``."""

    def joined(parts: Column) -> Column:
        shown = F.transform(parts["found"], lambda c: F.when(let(c["features"], forest.score) >= threshold, F.lit(mask)).otherwise(c["value"]))
        both = F.arrays_zip(parts["between"].alias("b"), F.concat(shown, F.array(F.lit(""))).alias("s"))
        return F.array_join(F.transform(both, lambda x: F.concat(x["b"], x["s"])), "")

    return let(parts, joined)


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Add ``findings`` to documents: ``start, length, value, score, is_secret`` of every candidate, in order of place.

    Null and empty texts have none; a text of any length is scanned whole.
    ``path_col`` names the column of paths, None if there is none; a missing one
    is an error. Other columns pass through, so repeated rows and clashing names
    do no harm, but for a column that is already named ``findings``, which is
    replaced.
    """
    parts = dissect(docs[text_col], docs[path_col] if path_col else None)
    return docs.withColumn("findings", let(parts, lambda p: judged(p["found"], forest, threshold)))


def redact(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, text_col: str = "text", path_col: str | None = "source", mask: str = MASK) -> DataFrame:
    """Documents with every secret in ``text_col`` replaced by ``mask``; all rows and columns stay, null texts too."""
    parts = dissect(docs[text_col], docs[path_col] if path_col else None)
    return docs.withColumn(text_col, F.when(docs[text_col].isNotNull(), masked(parts, forest, threshold, mask)))
