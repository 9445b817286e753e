"""Languages of documents and of the passages in them, whatever their labels say."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.common import spread

#: The languages told apart, and the spellings of labels (small letters, up to the first - or _).
LANGS = ["en", "de", "fr", "es", "pt", "it", "nl"]
LABELS = {
    "en": "en eng english englisch anglais inglés ingles inglês inglese engels",
    "de": "de deu ger german deutsch allemand alemán aleman alemão tedesco duits",
    "fr": "fr fra fre french français francais französisch franzoesisch francés frances francês francese frans",
    "es": "es spa esp spanish español espanol castellano spanisch espagnol espanhol spagnolo spaans",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portoghese portugees",
    "it": "it ita italian italiano italienisch italien italiaans",
    "nl": "nl nld dut dutch nederlands niederländisch niederlaendisch néerlandais neerlandais neerlandés holandés holandês olandese flemish vlaams hollands",
}
#: The classifier is fitted on at most so many labelled documents of at most so many characters (those with the smallest
#: hash), at most so many of their sentences per language, with so many landmark sentences.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SENTENCES, LANDMARKS = 4000, 20_000, 700, 420
#: Presence kernel over blended spectra: n-grams of these lengths, hashed to 2^BITS places; ridge of the regression.
NGRAMS, BITS, RIDGE = (2, 3, 4), 16, 0.05
#: Another language than a text's main one enters it with a sentence whose score leads by ENTER; sentences of two languages
#: alike (a whole sentence leads by about two) then go to it too if they lead by MIX. At most so many sentences of a document
#: are trained on.
ENTER, MIX, SAMPLE_OF_DOC = 0.9, 0.3, 8

_FENCE = re.compile(r"^[ \t]*(```|~~~)[\s\S]*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M)
_TICKS = re.compile(r"(`+)[^`\n]*?\1|``")
_END = re.compile(r"(?<=[.!?…])(?:[\"'”’»)\]*_]*(?:\s+|\Z)|[^\w\s.!?…,;:/\\-]|[^A-Za-zÀ-ÿ]*\Z)")
_BULLET = re.compile(r"^[ \t]*(?:>[ \t]*)*(?:[-*+•][ \t]+|\d+[.)][ \t]+)?(?:\[[ xX]\][ \t]+)?")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_PLAIN_WORD = re.compile(r"[a-z]+(?:'[a-z]+)*")
_CODE_WORD = re.compile(r"[^\W\d]_[^\W\d]|[a-z][A-Z][a-z]|://|\(\)|[{}=<>;\d]")
_SERVICE = re.compile(r"\b[a-z]+-(?:svc|api|db|job)\b|\b[A-Z]+-(?:SVC|API|DB|JOB)\b")


def label(text: str | None) -> str | None:
    """The language that a label names in any spelling; "" for one that names another, None for one that names none."""
    if text is None:
        return None
    low = re.split(r"[-_ (]", text.strip().lower())[0] if text.strip() else ""
    if low in ("", "?", "und", "unknown", "xx", "xxx", "zxx", "mul", "mis", "none", "null", "nan", "n/a", "na", "other", "unk", "undefined", "undetermined", "auto", "multi", "mixed", "-", "--"):
        return None
    for lang, names in LABELS.items():
        if low in names.split():
            return lang
    return "" if re.fullmatch(r"[^\W\d_]{2,}", low) else None


def prose(s: str) -> str:
    """A sentence without names of code and of services."""
    if _CODE_WORD.search(s):
        s = " ".join(w for w in s.split() if not _CODE_WORD.search(w))
    return _SERVICE.sub(" ", s) if "-" in s else s


def sentences(text: str) -> list[tuple[int, str]]:
    """(offset, sentence) of the whole sentences: prose that ends with a full stop, question or exclamation mark and has
    at least three words besides names of code; headings, code, tables and quoted messages in backticks are none."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    text = _TICKS.sub(blank, _FENCE.sub(blank, text))
    out = []
    at = 0
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        bare = line.strip()
        if not bare or bare[0] in "#|" or bare.startswith(("    ", "\t")):
            continue
        lead = _BULLET.match(line).end()
        begin = lead
        for m in _END.finditer(line, lead):
            s = line[begin : m.start()]
            if len(_WORD.findall(prose(s))) >= 3:
                out.append((start + begin, s))
                begin = m.end()
            elif re.search(r"[^\W\d]{2}$", s.rstrip(".!?…")) is None:
                continue  # an abbreviation or number: no end
            else:
                begin = m.end()
    return out


def plain(s: str) -> str:
    """Small letters without accents; names of code and all that is no letter are blanks."""
    s = unicodedata.normalize("NFKD", prose(s).replace("’", "'").replace("ß", "ss")).encode("ascii", "ignore").decode().lower()
    return " " + " ".join(_PLAIN_WORD.findall(s)) + " "


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of each different n-gram of each text, sorted. At most 2^(32 - BITS) texts."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32), lens) << np.uint32(BITS)
    keys = []
    for n in NGRAMS:
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + codes[j : len(codes) - n + 1 + j]
        h = (h ^ (h >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)
        same = owner[: len(h)] == owner[n - 1 :]
        keys.append((owner[: len(h)] | (h >> np.uint64(64 - BITS)).astype(np.uint32))[same])
    k = np.sort(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.uint32)
    k = k[np.r_[True, k[1:] != k[:-1]]] if len(k) else k
    return (k >> np.uint32(BITS)).astype(np.int64), (k & np.uint32((1 << BITS) - 1)).astype(np.int64)


def presence(texts: list[str]) -> np.ndarray:
    """Rows of presence, scaled so that a text's kernel with itself is one."""
    row, col = grams(texts)
    x = np.zeros((len(texts), 1 << BITS), dtype=np.float32)
    x[row, col] = 1
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(texts: list[str], langs: list[str]) -> np.ndarray:
    """Nyström kernel ridge regression, one language against the rest, as one matrix from places to languages.

    Landmarks are dealt evenly over the languages; with K their kernel, texts are mapped to K(text, landmarks) K^-1/2 and
    regressed with weights that balance the languages. As the kernel is a product of presence rows, the landmarks, K^-1/2
    and the regression multiply out to one matrix. Fitted twice: the second time without the samples whose label the
    first fit contradicts, since labels are known to be wrong at times.
    """
    y = np.array([LANGS.index(x) for x in langs])
    keep = np.ones(len(texts), dtype=bool)
    v = np.zeros((1 << BITS, len(LANGS)), dtype=np.float32)
    blocks = lambda m: np.concatenate([score(texts[i : i + 200], m) for i in range(0, len(texts), 200)])
    for _ in range(2):
        marks = np.concatenate([np.flatnonzero(keep & (y == k))[: LANDMARKS // len(LANGS)] for k in range(len(LANGS))])
        lm = presence([texts[i] for i in marks])
        values, vectors = np.linalg.eigh((lm @ lm.T).astype(np.float64) + 1e-6 * np.eye(len(marks)))
        root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        phi = blocks(np.ascontiguousarray(lm.T))[keep] @ root
        yy = y[keep]
        share = np.bincount(yy, minlength=len(LANGS))
        w = (1.0 / np.maximum(share, 1))[yy] * len(yy) / len(LANGS)
        goal = np.where(yy[:, None] == np.arange(len(LANGS)), 1.0, -1.0)
        beta = np.linalg.solve((phi * w[:, None]).T @ phi + RIDGE * len(yy) / 100 * np.eye(len(marks)), (phi * w[:, None]).T @ goal)
        v = np.asfortranarray(lm.T @ (root @ beta).astype(np.float32), dtype=np.float32)
        keep = keep & (blocks(v).argmax(1) == y)
    return v


def score(texts: list[str], v: np.ndarray) -> np.ndarray:
    """Scores of the languages for each text: the batch's presence rows times the fitted matrix."""
    row, col = grams(texts)
    out = np.zeros((len(texts), v.shape[1]), dtype=np.float64)
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        for k in range(v.shape[1]):
            out[row[first], k] = np.add.reduceat(v[:, k][col], first)
        out[row[first]] /= np.sqrt(np.diff(np.r_[first, len(row)]))[:, None]
    return out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> np.ndarray | None:
    """The classifier fitted on the bounded sample; None when no document has both a usable label and a sentence."""
    first = F.lower(F.trim(F.regexp_extract(F.trim(lang), r"^[^-_ (]+", 0)))
    pairs = F.create_map(*[F.lit(x) for k, names in LABELS.items() for n in names.split() for x in (n, k)])
    usable = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), pairs[first].alias("l")).where(F.col("l").isNotNull() & F.length("t").between(41, SAMPLE_CHARS))
    sample = usable.withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(SAMPLE_DOCS).select("h", "t", "l")

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for h, t, l in zip(b["h"], b["t"], b["l"], strict=True):
                found = sentences(t)
                rows += [(h, n, l, p) for n, (_, s) in enumerate(found[:: max(1, len(found) // SAMPLE_OF_DOC)]) if len(p := plain(s)) > 20]
            yield pd.DataFrame(rows, columns=["h", "n", "l", "p"])

    # Dealt out again, as a limit comes in one partition; only the sentences come to the driver.
    got = sample.repartition(docs.sparkSession.sparkContext.defaultParallelism, "h").mapInPandas(cut_up, "h long, n int, l string, p string").collect()
    texts: list[str] = []
    langs: list[str] = []
    count = dict.fromkeys(LANGS, 0)
    for r in sorted(got):
        if count[r["l"]] < SAMPLE_SENTENCES:
            count[r["l"]] += 1
            texts.append(r["p"])
            langs.append(r["l"])
    return fit(texts, langs) if texts else None


def passages(text: str, spans: list[tuple[int, str]], scores: np.ndarray) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of maximal runs of sentences in one language.

    The text's main language leads by the sum over its sentences. Another one enters the text only with a sentence that
    leads clearly (ENTER), as related languages share sentences; its other sentences then need no more than MIX. Confidence is the mean share of the language in the softmax of its sentences' scores.
    """
    if not spans:
        return []
    main = int(scores.sum(0).argmax())
    soft = np.exp(6 * (scores - scores.max(1, keepdims=True)))
    soft /= soft.sum(1, keepdims=True)
    best = scores.argmax(1)
    lead = scores.max(1) - scores[:, main]
    entered = np.isin(best, np.unique(best[lead >= ENTER]))
    best = np.where(entered & (lead >= MIX), best, main)
    out: list = []
    for (at, s), k, p in zip(spans, best.tolist(), soft, strict=True):
        if out and out[-1][2] == k:
            out[-1][1] = at + len(s)
            out[-1][3].append(float(p[k]))
        else:
            out.append([at, at + len(s), k, [float(p[k])]])
    return [(a, b, LANGS[k], round(sum(c) / len(c), 4)) for a, b, k, c in out]


def language_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, start, end, language, confidence, label_lang): passages of every text with a sentence, offsets in code points.

    ``label_lang`` is the language the label names, empty for another language, null for none. Null, empty and blank
    texts, code and texts of single words have no passage and no rows; a repeated key has the rows of each of its texts.
    Only the bounded sample and the fitted matrix pass the driver; all texts are read whole, where they lie.
    """
    v = train(docs, key, text, lang)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start int, end int, language string, confidence double, label_lang string"
    if v is None:
        return docs.sparkSession.createDataFrame([], schema)
    held = docs.sparkSession.sparkContext.broadcast(v)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [sentences(t) for t in b[text]]
            flat = [plain(s) for x in spans for _, s in x]
            scores = np.concatenate([score(flat[i : i + 4000], held.value) for i in range(0, len(flat), 4000)]) if flat else np.zeros((0, len(LANGS)))
            rows, at = [], 0
            for k, t, l, x in zip(b[key], b[text], b[lang], spans, strict=True):
                named = label(l)
                rows += [(k, *p, named) for p in passages(t, x, scores[at : at + len(x)])]
                at += len(x)
            yield pd.DataFrame(rows, columns=[key, "start", "end", "language", "confidence", "label_lang"])

    return spread(docs.select(key, text, lang).where(F.length(F.trim(text)) > 0)).mapInPandas(classify, schema)


def wrong_labels(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang): one row per language of each document whose label is missing or wrong, or that mixes languages."""
    per = found.groupBy(key).agg(F.array_sort(F.collect_set("language")).alias("_langs"), F.first("label_lang").alias("_label"))
    case = F.col("_label").isNull() | (F.size("_langs") > 1) | ~F.array_contains("_langs", F.col("_label"))
    return per.where(case).select(key, F.explode("_langs").alias("lang"))
