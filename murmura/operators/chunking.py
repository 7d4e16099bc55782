"""Texts to chunks."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.operators.ordered import numbered

# Where texts may be cut, and what a word is.
PARAGRAPH = r"\n\s*\n+"
SENTENCE = r"(?<=[。！？；!?;])\s*|(?<=[A-Za-z0-9][.])\s+"
CLAUSE = r"(?<=[，,、：:])\s*|\s+"
WORD = "[A-Za-z][A-Za-z0-9_'-]{2,}|[一-鿿]{2,}"


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under the chunk size")


def paragraphs(text: Column) -> Column:
    """Stripped paragraphs that aren't empty."""
    return F.filter(F.transform(F.split(text, PARAGRAPH), strip), lambda p: p != "")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def distinct_terms(text: Column) -> Column:
    """Lower-cased words of three characters or more, each at its first place."""
    return F.array_distinct(F.filter(F.transform(words(text), F.lower), lambda w: F.length(w) >= 3))


def drawn_terms(terms: Column, *key: Column, most: int = 8) -> Column:
    """Up to `most` of the terms, in an order drawn by key."""
    keyed = F.transform(terms, lambda x: F.struct(F.md5(F.concat_ws("|", *key, x)).alias("h"), x.alias("x")))
    return F.transform(F.slice(F.sort_array(keyed), 1, most), lambda s: s.x)


def query_text(content: Column, *key: Column, most: int = 8, least: int = 4, snippet: int = 16) -> Column:
    """What one would ask for a text: up to `most` of its terms in an order drawn by key; under `least` terms its first words, and without any a fixed topic."""
    first = F.array_join(F.slice(F.split(strip(content), r"(?U)\s+"), 1, snippet), " ")
    asked = lambda terms: F.when(F.size(terms) >= least, F.array_join(drawn_terms(terms, *key, most=most), " "))
    found = F.get(F.transform(F.array(distinct_terms(content)), asked), F.lit(0))  # terms are sought once
    return F.coalesce(found, F.nullif(first, F.lit("")), F.lit(TOPIC))


def generated_queries(chunks: DataFrame, n: int, seed: int, id_cols: tuple[str, ...] = ("doc_id", "chunk_id"), text_col: str = "content") -> DataFrame:
    """(query_no, *id_cols, query): n queries, from 1, of chunks in an order drawn by the seed; should there be fewer chunks, numbered topics fill the rest."""
    ids = [F.col(c).cast("string") for c in id_cols]
    keyed = chunks.withColumn("__key", F.md5(F.concat_ws("|", F.lit(str(seed)), *ids)))
    there = chunks.count()
    if n < there:
        keyed = keyed.orderBy("__key", *id_cols).limit(n)
    asked = numbered(keyed.select("__key", *id_cols, query_text(F.col(text_col), F.lit(str(seed)), *ids).alias("query")), [F.col("__key"), *map(F.col, id_cols)], "query_no")
    asked = asked.select("query_no", *id_cols, "query")
    if n <= there or not there:
        return asked
    rest = chunks.sparkSession.range(there + 1, n + 1).select(F.col("id").alias("query_no"), F.concat(F.lit(f"{TOPIC} "), F.col("id").cast("string")).alias("query"))
    return asked.unionByName(rest, allowMissingColumns=True)


def preview(text: Column, width: int) -> Column:
    one_line = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(one_line) > width, F.concat(F.substring(one_line, 1, width - 1), F.lit("…"))).otherwise(one_line)


def prompt_cut(text: Column, width: int = 1000) -> Column:
    return F.concat(F.substring(text, 1, width), F.lit("..."))


def answer_parts(text: Column, mark: str = "</think>") -> Column:
    """Struct of what stands before and after the first mark; without one all of it is the answer."""
    parts = F.split(text, mark, 2)
    return F.struct(F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("")).alias("thought"), F.element_at(parts, -1).alias("answer"))


def sliding(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, start, content): windows of size characters, each starting overlap before the last one's end."""
    check_sizes(size, overlap)
    n, step = F.length(text_col), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(n - overlap, F.lit(1)) - 1, F.lit(step))
    rows = docs.where(n > 0).select(id_col, text_col, F.posexplode(starts).alias("chunk_id", "start"))
    return rows.select(id_col, "chunk_id", "start", F.expr(f"substring({text_col}, start + 1, {size})").alias("content"))


def _units(text: str, size: int) -> Iterator[str]:
    for paragraph in re.split(PARAGRAPH, text):
        for sentence in filter(None, map(str.strip, re.split(SENTENCE, paragraph.strip()))):
            yield from [sentence] if len(sentence) <= size else _pack(sentence, size)


def _pack(unit: str, size: int) -> Iterator[str]:
    """Clauses of a long unit joined up to size; a clause that is too long itself is wrapped."""
    held = ""
    parts = [p.strip() for p in re.split(CLAUSE, unit) if p and p.strip()]
    if len(parts) < 2:
        yield from textwrap.wrap(unit, size, break_long_words=True, break_on_hyphens=False, replace_whitespace=False, drop_whitespace=True)
        return
    for part in parts:
        if held and len(held) + 1 + len(part) <= size:
            held = f"{held} {part}"
            continue
        if held:
            yield held
        held = ""
        if len(part) > size:
            yield from _pack(part, size)
        else:
            held = part
    if held:
        yield held


def greedy_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Units joined by line ends while they fit max(1, size - overlap); nothing is repeated."""
    soft, out, held = max(1, size - overlap), [], ""
    for unit in _units(text or "", size):
        if held and len(held) + 1 + len(unit) <= soft:
            held = f"{held}\n{unit}"
        else:
            if held:
                out.append(held)
            held = unit
    return out + [held] if held else out


def semantic(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, content) by greedy assembly; state runs along a text, so texts go to Python."""
    check_sizes(size, overlap)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, c) for i, t in zip(frame[id_col], frame[text_col]) for n, c in enumerate(greedy_chunks(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_id", "content"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, chunk_id int, content string")


def panel(text: Column, width: int) -> Column:
    """Lines without blanks at their ends, cut to a width with '...'."""
    lines = F.array_join(F.transform(F.split(strip(text), "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")
    cut = F.regexp_replace(F.substring(lines, 1, max(0, width - 3)), r"(?U)\s+$", "")
    return F.when(F.length(lines) <= width, lines).otherwise(F.concat(cut, F.lit("...")))


# Fixed value: what is asked of a text without words.
TOPIC = "general document topic"

# The parts of a prompt, with {role}, {identity}, {found} and {question} to be put in.
CONTEXT = "AI Identity/Persona\n{identity}\n\n【知识库检索结果】\n{found}"
PROMPT = """你是一名智能问答助手(扮演{role})，以下是你的身份描述和检索到的文档内容:
{context}

请遵守identity.md中的所有“沟通风格准则”和“特殊行为准则”，并根据文档做出回答。
如果在知识库中找不到答案，请回答“对不起，我在知识库中没有找到相关信息”。
请使用简洁且专业的口吻。
用户的问题：{question}

请直接给出简洁且专业的回答："""


def filled(template: str, **values: Column) -> Column:
    """A template with columns put in."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def prompts(found: DataFrame, records: DataFrame, questions: DataFrame, identity_text: Column, role: str = "知识管家") -> DataFrame:
    """(query_id, prompt): found (query_id, rank, doc_id), records (doc_id, filename, chunk_id, content), questions (query_id, question); without any entry the prompt says nothing was found by an empty list."""
    entries = found.join(records, "doc_id").select("query_id", F.struct("rank", prompt_entry(F.col("filename"), F.col("chunk_id"), F.col("content")).alias("entry")).alias("e"))
    listed = entries.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x.entry), "\n\n").alias("found"))
    whole = filled(PROMPT, role=F.lit(role), context=filled(CONTEXT, identity=identity_text, found=F.coalesce("found", F.lit(""))), question=F.col("question"))
    return questions.join(listed, "query_id", "left").select("query_id", strip(whole).alias("prompt"))


# What an answer may repeat of its prompt, and what stands for an empty answer.
ECHOES = ("用户的问题：{q}", "用户的问题:{q}", "问题：{q}", "问题:{q}", "{q}", "请直接给出简洁且专业的回答：", "请直接给出简洁且专业的回答:")
NO_ANSWER = "对不起，我没有生成有效回答，请重试或调整提示词。"


def cleaned_answer(answer: Column, query: Column) -> Column:
    """The answer without what it repeats of its prompt, each echo once and in order; a sentence for an empty one."""
    marks = [F.concat(F.lit(before), query) if q else F.lit(before) for before, q, _ in (echo.partition("{q}") for echo in ECHOES)]
    rest = lambda out, mark: F.when(F.startswith(out, mark), strip(F.substr(out, F.length(mark) + 1))).otherwise(out)
    out = F.aggregate(F.array(*marks), strip(answer), rest)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(NO_ANSWER))


def prompt_entry(name: Column, chunk: Column, content: Column) -> Column:
    """What the prompt shows of one chunk that was found."""
    return F.concat(F.lit("📄【"), name, F.lit("#chunk-"), chunk.cast("string"), F.lit("】\n"), prompt_cut(content))


def identity(text: Column) -> Column:
    """The text that sets the answering role, with its heading."""
    return F.concat(F.lit("[系统角色提示]\n"), text, F.lit("\n\n"))
