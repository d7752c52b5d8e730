"""Source that nobody wrote by hand for its project: generated, minified, vendored files and data blobs.

Labels come from header notices and path conventions, and for data blobs, which carry
neither, from the share of their literals; a random forest learns what such files look like
from measures of the text that show none of these, and finds those that carry no notice.
Where a body looks like any other (vendored copies, and generated code that reads as if hand-written) no
measure can tell, and the notice itself is the evidence; every row says which of the two it rests on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.session import cut

#: Labelled rows the forest is trained on at most, taken by hash of the id; the measures cover all files.
TRAINING_ROWS = 20_000
#: The probability from which the forest, which weighs both labels alike, takes a file.
SURE = 0.5
#: The first forests' probability from which a file that teaches 0 does not teach again.
DOUBTFUL = 0.8
TREES, DEPTH, SEED = 40, 8, 7
#: A file is judged by a forest that was taught by the files of the other folds.
FOLDS = 2
FEATURES = (
    "compression", "token_entropy", "char_entropy", "identifier_length", "short_identifiers", "comment_density", "line_length", "longest_line",
    "white_space", "digits", "longest_literal", "number_tokens", "shape_repetition", "numbered_names", "log_lines", "code_share",
)
#: A text without a notice teaches what a data blob is if its literals have this share of it; the forest does not see that share.
BLOB = 0.85

_SOURCE = re.compile(r"\.(?:ts|tsx|mts|cts|js|jsx|mjs|cjs|py|pyi|go|rs|dart)$", re.I)
# Wordings of notices and names of folders in public use.
GENERATED_NOTICE = re.compile(
    r"code generated .*do not edit|@generated\b|<auto-generated>|auto-?generated (?:from|by|file)|\b(?:is|was|been) (?:automatically|auto-?) ?(?:generated|created)"
    r"|generated at \w+ time by|generated by .*(?:do not|don't)|produced by \S+; edit|\bautomatisch (?:erzeugt|generiert)|généré automatiquement|generado automáticamente"
    r"|do not (?:edit|modify)(?: this file| by hand| manually)?[.!]?\s*$|manual changes will be lost|end of generated (?:section|code)|generated section; run|ne pas modifier|änderungen werden überschrieben",
    re.I | re.M,
)
MINIFIED_NOTICE = re.compile(r"/\*! \S+ v\d+\.\d+\.\d+")
MAP_REFERENCE = re.compile(r"//[#@] sourceMappingURL=")
VENDORED_NOTICE = re.compile(
    r"vendored from|copied verbatim from|third-party code|upstream: https?://|changes upstream|^\W*! \S+ v\d+(?:\.\d+)* \| \(c\)|distribution\.\s*$",
    re.I | re.M,
)
GENERATED_PATH = re.compile(r"(?:^|/)(?:__generated__|generated|gen-src|codegen-out)/|\.(?:gen|generated|g|freezed|pb|pb\.gw)\.\w+$|(?:_pb2|_pb2_grpc)\.pyi?$|_gen\.go$|_pb\.(?:js|ts)$|_generated\.\w+$", re.I)
MINIFIED_PATH = re.compile(r"[.-](?:min|bundle|chunk)\.[mc]?js$", re.I)
VENDORED_PATH = re.compile(r"(?:^|/)(?:vendor|third_party|third-party|node_modules|bower_components|deps|external|Pods|site-packages)/")

_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|\"\"\"|'''|<!--)")
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_SHAPE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\W\d]\w*|\d[\w.]*")


def header_of(text: str) -> tuple[str, str]:
    """The comments a text opens with, and the rest."""
    lines = text.split("\n")
    n, closing = 0, ""
    while n < len(lines):
        line = lines[n].strip()
        if closing:
            closing = "" if closing in line else closing
        elif opened := re.match(r"\"\"\"|\'\'\'|/\*|<!--", line):
            closing = {"/*": "*/", "<!--": "-->"}.get(opened[0], opened[0])
            if closing in line[len(opened[0]) :]:
                closing = ""
                if line.startswith("/*") and not line.endswith("*/"):
                    break
        elif line and not _COMMENT.match(line):
            break
        n += 1
    return "\n".join(lines[:n]), "\n".join(lines[n:])


def without_notices(text: str) -> tuple[str, str]:
    """The comments a text opens and closes with, and what lies between."""
    head, body = header_of(text)
    lines = body.rstrip().split("\n")
    n = len(lines)
    while n > 0 and (not lines[n - 1].strip() or _COMMENT.match(lines[n - 1])):
        n -= 1
    return head + "\n" + "\n".join(lines[n:]), "\n".join(lines[:n])


def evidence_of(path: str, text: str) -> tuple[str | None, bool]:
    """``notice`` or ``path`` for what states that a file is not hand-written here, else None; and whether such files have looks the
    forest can learn (generated or minified), which vendored ones, as they look like any other, have not."""
    head, _ = header_of(text)
    notices, _ = without_notices(text)
    vendored = bool(VENDORED_NOTICE.search(head))
    if vendored or GENERATED_NOTICE.search(notices) or MINIFIED_NOTICE.match(text) or MAP_REFERENCE.match(text.rstrip().rpartition("\n")[2]):
        return "notice", not vendored and not VENDORED_PATH.search(path)
    if GENERATED_PATH.search(path) or MINIFIED_PATH.search(path) or VENDORED_PATH.search(path):
        return "path", not VENDORED_PATH.search(path)
    return None, False


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum()) if len(p) else 0.0


def measures(text: str) -> tuple[list[float], float]:
    """The values of :data:`FEATURES` of a text without its header, closing comments and map reference; and the share of its long literals and numbers."""
    body = re.sub(r"(?m)^//[#@] sourceMappingURL=.*$|\A/\*![^\n]*\*/", "", without_notices(text)[1])
    raw = body.encode("utf-8", "replace")
    size = max(1, len(raw))
    tokens = _TOKEN.findall(body)
    names = [t for t in tokens if t[0].isalpha() or t[0] == "_"]
    counts: dict[str, int] = {}
    for t in tokens:
        counts[t] = counts.get(t, 0) + 1
    lines = [x for x in body.split("\n") if x.strip()]
    shapes = {_SHAPE.sub(lambda m: "0" if m[0][0].isdigit() else "i", x.strip()) for x in lines}
    comments = sum(1 for x in lines if _COMMENT.match(x))
    literals = [len(x) for x in _LITERAL.findall(body)]
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total, n = max(1, len(tokens)), max(1, len(names))
    longest = max((len(x) for x in lines), default=0)
    data = sum(x for x in literals if x > 100) + sum(len(t) + 1 for t in tokens if t[0].isdigit())
    values = [
        len(zlib.compress(raw, 1)) / size,
        _entropy(np.fromiter(counts.values(), np.int64, len(counts))),
        _entropy(chars),
        sum(map(len, names)) / n,
        sum(1 for x in names if len(x) <= 2) / n,
        comments / max(1, len(lines)),
        size / max(1, len(lines)),
        longest / size,
        float(chars[9] + chars[10] + chars[32]) / size,
        float(chars[48:58].sum()) / size,
        max(literals, default=0) / size,
        sum(1 for t in tokens if t[0].isdigit()) / total,
        1 - len(shapes) / max(1, len(lines)),
        sum(1 for x in names if x[-1].isdigit()) / n,
        log2(1 + len(lines)),
        (len(lines) - comments) / max(1, body.count("\n") + 1),
    ]
    return values, data / max(1, size - int(chars[9] + chars[10] + chars[32]))


def _measure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, values, evidence, taught = [], [], [], []
        for i, path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if not path or not _SOURCE.search(path):
                continue
            text = (text or "").replace("\r\n", "\n")
            why, looks = evidence_of(path, text)
            found, data = measures(text)
            ids.append(i)
            values.append(found)
            evidence.append(why)
            taught.append((1 if looks else None) if why else int(data >= BLOB))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(values, pa.list_(pa.float64())), pa.array(evidence, pa.string()), pa.array(taught, pa.int32())],
            names=["file_id", "features", "evidence", "taught"],
        )


def measure_files(files: DataFrame) -> DataFrame:
    """``(file_id, features, evidence, taught)`` of each source file, once; a null text counts as empty.

    ``taught`` is what a file teaches the forest: 1 for generated and minified files by their notice or path and for
    blobs, 0 for those without either, null for vendored ones.
    """
    rows = files.where("file_id is not null").select("file_id", "path", "text")
    measured = rows.mapInArrow(_measure_rows, "file_id long, features array<double>, evidence string, taught int")
    return measured.dropDuplicates(["file_id"])


def _fold() -> Column:
    return F.pmod(F.xxhash64("file_id", F.lit(FOLDS)), F.lit(FOLDS))


def train(measured: DataFrame, rows: int = TRAINING_ROWS) -> list[RandomForestClassificationModel] | None:
    """Forests over at most ``rows`` taught rows, one for each fold of the files, which it has not seen; one for all where a fold's others don't have both
    labels, and None where not even all have. A file without a notice teaches 0, so a forest that has seen it may only repeat that.

    Of each label a forest takes up to half, in order of a hash of the id, and weighs the two alike: the rows that teach 0 are many, and
    some of them are cases without a notice, which the weight keeps from deciding.
    """
    taught = measured.where("taught is not null").select("file_id", F.col("taught").alias("label"), array_to_vector("features").alias("features"))
    forests = _forests(taught, rows, TREES // 2)
    if forests is None:
        return None
    # Cases without a notice teach the wrong label; those the first forests take for such are left out of the second teaching.
    doubtful = cut(_judged(taught.where("label = 0"), forests).where(F.col("probability") >= DOUBTFUL).select("file_id"), "doubtful")
    return _forests(taught.join(doubtful, "file_id", "left_anti"), rows) or forests


def _forests(taught: DataFrame, rows: int, trees: int = TREES) -> list[RandomForestClassificationModel] | None:
    forests = [_forest(taught.where(_fold() != k), rows, trees) for k in range(FOLDS)]
    if all(forests):
        return forests
    one = _forest(taught, rows, trees)
    return [one] * FOLDS if one else None


def _judged(rows: DataFrame, forests: list[RandomForestClassificationModel]) -> DataFrame:
    """``rows`` with the ``probability`` of the forest that has not seen each."""
    parts = [forest.transform(rows.where(_fold() == k)).withColumn("probability", vector_to_array("probability")[1]) for k, forest in enumerate(forests)]
    return reduce(DataFrame.unionByName, parts)


def _forest(taught: DataFrame, rows: int, trees: int) -> RandomForestClassificationModel | None:
    halves = [taught.where(F.col("label") == k).orderBy(F.xxhash64("file_id"), "file_id").limit(rows // 2) for k in (0, 1)]
    # Read many times in fitting, and no larger than ``rows``.
    sample = cut(halves[0].unionByName(halves[1]).withColumn("label", F.col("label").cast("double")), "sample")
    counts = {int(r["label"]): r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    weighed = sample.withColumn("weight", F.when(F.col("label") == 1, counts[0] / counts[1]).otherwise(1.0))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2, weightCol="weight")
    return forest.fit(weighed)


def find_not_handwritten(measured: DataFrame, forests: list[RandomForestClassificationModel] | None) -> DataFrame:
    """``(file_id, evidence, probability)`` of the files a forest takes for not hand-written, and of those a notice or a path states to be so.

    ``evidence`` is ``forest`` where the forest is sure, whatever the notice says, else ``notice`` or ``path``; the probability is the forest's for
    every row, of the one that has not seen the file. ``measured`` is read again: pass a written table. Without forests (nothing to learn from) notices and paths decide alone.
    """
    if forests is None:
        return measured.where("evidence is not null").select("file_id", "evidence", F.lit(None).cast("double").alias("probability"))
    judged = _judged(measured.withColumn("features", array_to_vector("features")), forests)
    why = F.when(F.col("probability") >= SURE, F.lit("forest")).otherwise(F.col("evidence"))
    return judged.select("file_id", why.alias("evidence"), "probability").where("evidence is not null")
