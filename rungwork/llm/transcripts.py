"""Problem 6: speech transcripts into clean, ordered speaker turns."""

from __future__ import annotations

import html as _html
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.operators.skew import last_in_blocks, running_sum_in_blocks, salted_join
from rungwork.session import materialize, table

UNKNOWN = "UNK"
#: Weights of the constraints: dialogue order (chunk numbers), cues (segment marks), timing (time stamps). A number
#: outweighs both others, as turns are to follow the order of chunks.
DIALOGUE, CUE, TIMING = 4, 2, 1

_BREAK = re.compile(r"<\s*br\s*/?>|</?\s*(?:p|div|li|tr|h\d|body|html)\b[^>]*>|\r?\n", re.IGNORECASE)
_MARKUP = re.compile(r"</?[a-z][^<>]*>", re.IGNORECASE)
_MARK = re.compile(r"^\s*<?\s*(?:begin|end)\s+segment\s+(\d+)\s*>?\s*$", re.IGNORECASE)
_PAGE = re.compile(r"^\s*(?:page\s+\d+(?:\s+of\s+\d+)?|[-–—]*\s*\d{1,4}\s*[-–—]*)\s*$", re.IGNORECASE)
_STAMP = re.compile(r"[\[(<]?\b\d{1,2}:\d{2}(?::\d{2})?(?:\.\d{1,3})?\b[\])>]?")
_CLOCK = re.compile(r"\b(?:(\d{1,2}):)?(\d{1,2}):(\d{2})(?:\.\d{1,3})?\b")
#: An e-mail address as typed, with (at) or [dot], is no noise.
_NOISE = re.compile(r"\[(?!(?:at|dot)\])[^\[\]]{0,60}\]|\((?!(?:at|dot)\))\(?[^()]{0,60}\){1,2}|\*[^*\n]{1,40}\*", re.IGNORECASE)
_FILLER = re.compile(r"(?<![\w-])(?:uh-huh|uh|um|erm|er|ah|hmm|mm|you know)(?![\w-])\s*,?", re.IGNORECASE)
_AGAIN = re.compile(r"\b([\w'’]+)(?:(?:\s+--)?\s+\1\b)+", re.IGNORECASE)
_LABEL = re.compile(r"^\s*(?:>>\s*)?(?:\[([^\[\]:]{1,40})\]\s*:?|([^:\[\]()<>*?!]{1,48}?)\s*:)\s*")
_VOICE = re.compile(r"^(?:an? )?(?:unidentified|unknown|male|female|man|woman|off-?camera|other|third)?\s*(?:voice|speaker|person|man|woman|unidentified|unknown)(?: \d+)?$", re.IGNORECASE)
_INITIALS = re.compile(r"^(?:[A-Za-z]\.?\s?){1,3}$")
_HEADER = re.compile(r"^\s*(narrator|interviewer)s?\s*:\s*(.+)$", re.IGNORECASE)
_HEADER_END = re.compile(r"^\s*(?:title|date|place|location|narrators?|interviewers?|videographer)\s*:", re.IGNORECASE)


def plain(text: str) -> str:
    """Letters without accents."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def initials(name: str) -> str:
    """Upper-case initials of a name without accents, three at most."""
    parts = [p for p in re.split(r"[\s.]+", plain(name)) if p[:1].isalpha()]
    return "".join(p[0] for p in parts[:3]).upper()


def lines_of(text: str) -> list[str]:
    """Paragraphs of a chunk: markup gone, entities resolved."""
    return [x for x in (_html.unescape(_MARKUP.sub(" ", p)).strip() for p in _BREAK.split(text)) if x]


def clean_text(text: str, begins: bool = True) -> str:
    """Text free of time stamps, annotations, fillers and false starts, with the capitals that sentences lost.

    The first word gets its capital only if the text ``begins`` a sentence.
    """
    out = _SPACE.sub(" ", _spoken(text)).strip()
    out = _AGAIN.sub(r"\1", out)
    out = _BEFORE_MARK.sub(r"\1", _LEADING.sub("", _DASHES.sub(" --", out))).strip()
    out = _LONE_I.sub("I", out)
    return (_BEGIN if begins else _LATER).sub(lambda m: m.group(1) + m.group(2).upper(), out)


_SPACE, _DASHES, _LEADING, _BEFORE_MARK, _LONE_I = (re.compile(p) for p in (r"\s+", r"\s+--(?=\s|$)", r"^[\s,;–—-]+", r"\s+([,.?!;:])", r"\bi\b"))
_BEGIN, _LATER = re.compile(r"(^|[.?!]\s+)([a-z])"), re.compile(r"([.?!]\s+)([a-z])")
_FIRST_WORD, _LETTER = re.compile(r"[\s\"'“‘–—-]*([^\W\d_]+)"), re.compile(r"[^\W_]")
#: First words of fillers and page marks.
_UNSURE = frozenset("uh um erm er ah hmm mm you page".split())


def _spoken(text: str) -> str:
    """A text without time stamps, annotations and fillers."""
    if ":" in text:
        text = _STAMP.sub(" ", text)
    if "[" in text or "(" in text or "*" in text:
        text = _NOISE.sub(" ", text)
    return _FILLER.sub(" ", text)


def has_words(text: str) -> bool:
    """Whether anything is said besides noise, fillers and time stamps."""
    m = _FIRST_WORD.match(text)
    if m and m.group(1).lower() not in _UNSURE:
        return True
    return not _PAGE.match(text) and bool(_LETTER.search(_spoken(text)))


def header_of(lines: list[str]) -> tuple[list[tuple[str, str]], int]:
    """``(name, role)`` of the persons in a first chunk and the number of header lines."""
    end = next((i for i, x in enumerate(lines) if _MARK.match(x)), None)
    if end is None:  # then the header ends with the first line that names nothing, or names a role again
        end, seen = 0, set()
        for i, x in enumerate(lines):
            m = _HEADER_END.match(x)
            if m and m.group(0).strip(" :s").lower() not in seen:
                seen.add(m.group(0).strip(" :s").lower())
                end = i + 1
            elif seen:
                break
    persons: list[tuple[str, str]] = []
    for x in lines[:end]:
        if m := _HEADER.match(x):
            for name in re.split(r"\s*(?:;|,|&|\band\b)\s*", re.sub(r"\([^)]*\)", "", m.group(2))):
                if name.strip() and (name.strip(), m.group(1).upper()) not in persons:
                    persons.append((name.strip(), m.group(1).upper()))
    return persons, end


def label_table(persons: list[tuple[str, str]]) -> dict[str, int]:
    """Ways in which a person of the header may be named, in lower case without accents and dots, to its place."""
    table_: dict[str, int] = {}
    first = {role: next((i for i, p in enumerate(persons) if p[1] == role), None) for role in ("NARRATOR", "INTERVIEWER")}
    for form, role in (("narrator", "NARRATOR"), ("a", "NARRATOR"), ("interviewer", "INTERVIEWER"), ("q", "INTERVIEWER")):
        if first[role] is not None:
            table_[form] = first[role]
    for level in range(4):
        for i, (name, _) in enumerate(persons):
            parts = [p for p in re.split(r"[\s.]+", plain(name).lower()) if p]
            if not parts:
                continue
            forms = ([" ".join(parts)], [initials(name).lower(), (parts[0][0] + parts[-1][0]) if len(parts) > 1 else parts[0][0]], [parts[-1], f"{parts[-1]} {' '.join(parts[:-1])}"], [parts[0], f"{parts[0]} {parts[-1]}"])[level]
            for f in forms:
                table_.setdefault(f, i)
    return table_


def _form(label: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[.,]", " " if len(label.replace(".", "").strip()) > 4 else "", plain(label).lower())).strip()


def speaker_of(line: str, persons: list[tuple[str, str]], forms: dict[str, int]) -> tuple[str | None, str]:
    """``(speaker, rest)``: the label at the start of a line, as the place of a person or ``UNK``, and what follows.

    The speaker is ``None`` where a line has no label. Something before a colon that is neither a person of the header,
    nor a voice, nor initials is no label.
    """
    rest = line
    while m := _STAMP.match(rest.lstrip()):
        rest = rest.lstrip()[m.end() :]
    m = _LABEL.match(rest)
    if not m:
        return None, rest
    label = (m.group(1) or m.group(2) or "").strip()
    form = _form(label)
    if form in forms:
        return str(forms[form]), rest[m.end() :]
    if form.replace(" ", "") in forms and _INITIALS.match(label):
        return str(forms[form.replace(" ", "")]), rest[m.end() :]
    if _VOICE.match(label):
        return UNKNOWN, rest[m.end() :]
    if m.group(2) and _INITIALS.match(label) and label == label.upper():
        return (UNKNOWN if persons else initials(" ".join(label.replace(".", "")))), rest[m.end() :]
    return None, rest


def parse_chunk(text: str, first: bool, persons: list[tuple[str, str]]) -> list[tuple[str | None, bool, str]]:
    """``(speaker, spoken, text)`` of the runs of one chunk; the speaker is ``None`` where the chunk before goes on."""
    lines = lines_of(text)
    if first:
        lines = lines[header_of(lines)[1] :]
    forms = label_table(persons)
    runs: list[list] = []
    now: str | None = None
    for line in lines:
        if _MARK.match(line) or _PAGE.match(line):
            continue
        speaker, rest = speaker_of(line, persons, forms)
        if speaker is not None:
            now = speaker
        spoken = has_words(rest)
        if runs and runs[-1][0] == now:
            runs[-1][1] |= spoken
            runs[-1][2] += " " + rest if spoken else ""
        else:
            runs.append([now, spoken, rest if spoken else ""])
    return [(s, w, clean_text(t, s is not None)) for s, w, t in runs]


def chunk_order(chunks: list[tuple[str, int | None, int | None, int | None]]) -> dict[str, int]:
    """Places of chunks ``(key, chunk number, first segment mark, first second)`` in their interview.

    Each kind of order gives precedence constraints between neighbours by it, with the weight of its kind. Several
    kinds that say the same add up. Constraints are taken by falling weight, and one that contradicts those taken is
    dropped. The rest is sorted topologically, ties by number, mark, time and key.
    """
    rank = {c[0]: tuple((v is None, v or 0) for v in c[1:]) + (c[0],) for c in chunks}
    weight: dict[tuple[str, str], int] = {}
    for kind, w in ((1, DIALOGUE), (2, CUE), (3, TIMING)):
        known = sorted((c for c in chunks if c[kind] is not None), key=lambda c: (c[kind], rank[c[0]]))
        for a, b in zip(known, known[1:], strict=False):
            if a[kind] < b[kind]:
                weight[a[0], b[0]] = weight.get((a[0], b[0]), 0) + w
    at = {k: i for i, k in enumerate(sorted(rank, key=rank.get))}
    place = dict(at)
    after: dict[str, list[str]] = {k: [] for k in rank}
    for a, b in sorted(weight, key=lambda e: (-weight[e], at[e[0]], at[e[1]])):
        if _add_edge(after, place, a, b):
            after[a].append(b)
    degree = dict.fromkeys(rank, 0)
    for ys in after.values():
        for y in ys:
            degree[y] += 1
    ready = [(rank[k], k) for k, n in degree.items() if not n]
    heapify(ready)
    out: dict[str, int] = {}
    while ready:
        _, k = heappop(ready)
        out[k] = len(out)
        for y in after[k]:
            degree[y] -= 1
            if not degree[y]:
                heappush(ready, (rank[y], y))
    return out


def _add_edge(after: dict[str, list[str]], place: dict[str, int], a: str, b: str) -> bool:
    """Whether ``a`` before ``b`` contradicts no path; ``place`` is kept a topological order of all edges.

    Only chunks placed between the two are looked at, so an edge that agrees with the places costs nothing.
    """
    low, high = place[b], place[a]
    if high < low:
        return True
    ahead, todo = {b}, [b]
    while todo:
        for y in after[todo.pop()]:
            if y == a:
                return False
            if y not in ahead and place[y] <= high:
                ahead.add(y)
                todo.append(y)
    between = sorted((k for k in place if low <= place[k] <= high), key=place.get)
    free = [place[k] for k in between]
    for k, p in zip([k for k in between if k not in ahead] + [k for k in between if k in ahead], free, strict=True):
        place[k] = p
    return True


def _order(pdf: pd.DataFrame) -> pd.DataFrame:
    num = lambda v: None if pd.isna(v) else int(v)
    place = chunk_order([(r.key, num(r.chunk_no), num(r.mark), num(r.second)) for r in pdf.itertuples()])
    return pd.DataFrame({"interview_id": pdf["interview_id"], "key": pdf["key"], "pos": pdf["key"].map(place).astype("int64")})


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        found = [[{"name": n, "role": r} for n, r in header_of(lines_of(t))[0]] for t in df["html"]]
        yield pd.DataFrame({"interview_id": df["interview_id"], "persons": found})


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        out = []
        for i, pos, text, who in zip(df["interview_id"], df["pos"], df["html"], df["persons"], strict=True):
            persons = [(p["name"], p["role"]) for p in who] if who is not None else []
            for n, (s, spoken, t) in enumerate(parse_chunk(text, pos == 0, persons)):
                known = s is not None and s.isdigit()
                out.append((i, (int(pos) << 32) + n, s, initials(persons[int(s)][0]) if known else s, persons[int(s)][1] if known else None, spoken, t))
        yield pd.DataFrame(out, columns=["interview_id", "at", "speaker", "tag", "role", "spoken", "text"])


def turns(transcripts: DataFrame) -> DataFrame:
    """``interview_id, turn_no, speaker_tag, role_gold, clean`` of uncut transcripts.

    A turn is all that one speaker says until another speaks, over paragraphs and chunks. Chunks are ordered by
    :func:`chunk_order`; one delivered again counts once. Rows with NULL interview or text are left out, a chunk without
    words makes no turn, and words before any label are said by ``UNK``. Texts are parsed chunk by chunk; the speaker
    and turn number are carried over in blocks, so no task holds a whole interview's text.
    """
    raw = transcripts.filter(F.col("interview_id").isNotNull() & F.col("html").isNotNull()).select("interview_id", "chunk_no", "html").distinct()
    chunks = materialize(raw.withColumn("key", F.md5(F.concat_ws("|", F.col("chunk_no").cast("string"), "html"))))
    mark = F.regexp_extract("html", r"(?i)begin segment (\d+)", 1)
    clock = lambda g: F.try_to_number(F.nullif(F.regexp_extract("html", r"\b(?:(\d{1,2}):)?(\d{1,2}):(\d{2})(?:\.\d{1,3})?\b", g), F.lit("")), F.lit("99"))
    second = F.coalesce(clock(1), F.lit(0)) * 3600 + clock(2) * 60 + clock(3)
    meta = chunks.select("interview_id", "key", "chunk_no", mark.try_cast("int").alias("mark"), second.cast("int").alias("second"))
    # ordered, and later parsed, in tasks of their own: adaptive execution would put so few bytes into one
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = materialize(meta.repartition(parts, "interview_id").groupBy("interview_id").applyInPandas(_order, "interview_id string, key string, pos long"))
    firsts = places.filter("pos = 0").join(chunks, ["interview_id", "key"])
    heads = firsts.select("interview_id", "html").mapInPandas(_headers, "interview_id string, persons array<struct<name: string, role: string>>")
    placed = salted_join(heads, places, "interview_id").repartition(parts, "interview_id", "key")
    texts = chunks.select("interview_id", "key", "html").repartition(parts, "interview_id", "key")
    rows = placed.join(texts, ["interview_id", "key"]).select("interview_id", "pos", "html", "persons").mapInPandas(_runs, "interview_id string, at long, speaker string, tag string, role string, spoken boolean, text string")
    rows = materialize(rows)
    chunk = 1 << 32
    who = F.when(F.col("speaker").isNotNull(), F.struct("speaker", "tag", "role"))
    said = last_in_blocks(rows.withColumn("_w", who), ["interview_id"], "at", "_w", "who", chunk).filter("spoken")
    said = said.withColumn("who", F.coalesce("who", F.struct(F.lit(UNKNOWN).alias("speaker"), F.lit(UNKNOWN).alias("tag"), F.lit(None).cast("string").alias("role"))))
    said = materialize(said.select("interview_id", "at", "who", "text").withColumn("_s", F.col("who.speaker")))
    before = last_in_blocks(said, ["interview_id"], "at", "_s", "_p", chunk, strict=True)
    begun = before.withColumn("_new", F.when(F.col("_p").eqNullSafe(F.col("_s")), 0).otherwise(1))
    numbered = running_sum_in_blocks(begun, ["interview_id"], "at", "_new", "turn_no", chunk)
    one = numbered.groupBy("interview_id", "turn_no").agg(F.first("who").alias("who"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("_t"))
    return one.select("interview_id", F.col("turn_no").cast("int").alias("turn_no"), F.col("who.tag").alias("speaker_tag"), F.col("who.role").alias("role_gold"), F.array_join(F.col("_t.text"), " ").alias("clean"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the uncut transcripts with the speaker of each."""
    return turns(table(spark, sf_dir, "transcripts")).select("interview_id", "turn_no", "speaker_tag")


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns with role and clean text."""
    return turns(table(spark, sf_dir, "transcripts"))


QUERIES = {"p6_found": p6_found, "p6_turns": p6_turns}
ORACLE: dict[str, str] = {}
