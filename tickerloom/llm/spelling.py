"""Spelling variants: words one edit apart, by a dictionary of pairs of trie nodes.

The vocabulary is held in two tries, one of the words and one of the words reversed, whose nodes
have numbers. A word of length l cut before its place i is the pair (node of the first i code
points, node of the rest): a *gap*. Left out the code point at place i, the pair (node of the
first i, node of what follows it) is a *skip*. Equal pairs stand for equal strings, so

* two words differ by one replaced code point exactly if they share a skip pair,
* a word turns into another by one deletion exactly if its skip pair is the other's gap pair.

The dictionary maps a pair to the words that have it. A pair's depth in the tries fixes place
and length, so it holds at most one gap and one skip for each letter of the alphabet: no
group grows with the data. Deleting any of several equal neighbours gives the same word; only
the first of them (``lead``) counts, so that each neighbour is met once.

Numbering: words are dealt by range and sorted, so that a word's new nodes are those below the
prefix it shares with the word before. Numbers count up within a task. A task's first words
may go on with nodes of the task before; the first and last word of each task (a bounded
number of rows) tell which, and those numbers are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.frames import fold, ids_and_texts, materialised, sub_batches

#: Letters of a run once A-Z are lower-cased.
LETTERS = "[a-zÀ-ÿ]"
SHORTEST = 7
FEWEST = 2
FACTOR = 10
#: Numbers of a task's nodes go up from its partition number times this.
SPAN = 1 << 40


# ---------------------------------------------------------------- vocabulary

def word_counts(
    docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, id_col: str = "doc_id",
    text_col: str = "text", change=None,
) -> DataFrame:
    """``word, n``: runs of letters with A-Z lower-cased, of at least ``shortest`` code points.

    Only runs that occur at least ``fewest`` times in all texts stay. ``change(doc_id, run)`` is a
    column that may rewrite a run before it is counted; it may drop a code point at most, so
    shorter runs are not extracted at all.
    """
    runs = F.regexp_extract_all(fold(F.col("text")), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))
    rows = ids_and_texts(docs, id_col, text_col).select("doc_id", F.explode(runs).alias("run"))
    word = change(F.col("doc_id"), F.col("run")) if change else F.col("run")
    counts = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.char_length("word") >= shortest) & (F.col("n") >= fewest))


# ---------------------------------------------------------------- trie nodes

def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] is common, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _numbered(words: DataFrame) -> DataFrame:
    """``word, n, id, part, nodes``: numbers of a task's own nodes along each word, by sorted words.

    ``id`` follows the order of the code points. ``nodes[i]`` stands for the first i + 1 of them.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        base = part * SPAN
        before, path, rank, used = "", [], 0, 0
        for batch in sub_batches(batches, column="word"):
            names = batch.column("word").to_pylist()
            flat: list[int] = []
            ends = [0]
            for word in names:
                shared = _common(before, word)
                new = len(word) - shared
                path = path[:shared] + list(range(base + used, base + used + new))
                used += new
                flat += path
                ends.append(len(flat))
                before = word
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            ids = pa.array(range(base + rank, base + rank + len(names)), pa.int64())
            rank += len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), ids, pa.array([part] * len(names), pa.int32()), nodes],
                names=["word", "n", "id", "part", "nodes"],
            )

    return (
        words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
        .mapInArrow(number, "word string, n long, id long, part int, nodes array<long>")
    )


def _continued(ends: list[tuple[int, str, str, list[int]]]) -> list[tuple[int, list[int]]]:
    """For each task the numbers, given by earlier ones, of the leading nodes of its first word.

    ``ends`` has part, first word, last word and the last word's nodes, in the order of the parts.
    """
    out: list[tuple[int, list[int]]] = []
    last, path = "", []
    for part, first, final, nodes in sorted(ends):
        known = path[: _common(last, first)]
        base = part * SPAN
        out.append((part, known))
        path = [known[x - base] if x - base < len(known) else x for x in nodes]
        last = final
    return out


def trie_nodes(words: DataFrame, name: str = "trie") -> DataFrame:
    """``word, n, id, nodes`` of a table of distinct words: a trie node's number along each word.

    Two words have the same number at a place exactly if they agree up to it. The table is
    stored, because numbers must not change. The driver sees two words a task.
    """
    own = materialised(_numbered(words), name)
    ends = own.groupBy("part").agg(
        F.min("word").alias("first"), F.max("word").alias("last"), F.max_by("nodes", "word").alias("nodes"),
    ).collect()
    known = _continued([tuple(r) for r in ends])
    spine = words.sparkSession.createDataFrame(known, "part int, known array<long>")
    joined = own.join(F.broadcast(spine), "part")  # one row a task
    at = lambda x: x - F.col("part") * F.lit(SPAN)
    nodes = F.transform(
        "nodes", lambda x: F.when(at(x) < F.size("known"), F.get("known", at(x).cast("int"))).otherwise(x)
    )
    return joined.select("word", "n", "id", nodes.alias("nodes"))


# ---------------------------------------------------------------- pairs

def pair_dictionary(forward: DataFrame, back: DataFrame) -> DataFrame:
    """``head, tail, id, n, skip, lead``: every gap and skip pair of the words of ``forward``.

    ``forward`` and ``back`` are the trie nodes of the words and of the words reversed.
    """
    back = back.select(F.reverse("word").alias("word"), F.reverse("nodes").alias("tails"))
    # the roots are -1; heads[i] are the first i code points, tails[i] those from place i on
    root = F.array(F.lit(-1).cast("long"))
    letters = F.split("word", "")
    ahead = F.concat(F.array(F.lit("")), F.slice(letters, F.lit(1), F.char_length("word") - 1))
    lead = F.zip_with(letters, ahead, lambda c, before: c != before)
    rows = forward.join(back, "word").select(
        "id", "n", F.concat(root, "nodes").alias("heads"), F.concat("tails", root).alias("tails"), lead.alias("lead"),
    )
    length = F.size("heads") - 1
    gaps = F.transform(
        F.arrays_zip("heads", "tails"),
        lambda x: F.struct(
            x["heads"].alias("head"), x["tails"].alias("tail"), F.lit(False).alias("skip"), F.lit(False).alias("lead")
        ),
    )
    rows = rows.withColumns({"_from": F.slice("heads", F.lit(1), length), "_to": F.slice("tails", F.lit(2), length)})
    skips = F.transform(
        F.arrays_zip("_from", "_to", "lead"),
        lambda x: F.struct(
            x["_from"].alias("head"), x["_to"].alias("tail"), F.lit(True).alias("skip"), x["lead"].alias("lead")
        ),
    )
    return rows.select("id", "n", F.explode(F.concat(gaps, skips)).alias("x")).select("id", "n", "x.*")


def neighbours(pairs: DataFrame) -> DataFrame:
    """``id, n_near, near_n, near_id``: number of near words, and n and id of the most frequent.

    Ties fall to the smallest id. Each pair's words meet in one group (see above: a gap and a
    skip a letter at most); a member is told the best of the others, not each of them.
    """
    # (-n, id) orders from the best; a word's other is the first of the group or the second
    member = F.struct((-F.col("n")).alias("less"), "id", "skip", "lead")
    groups = (
        pairs.groupBy("head", "tail").agg(F.collect_list(member).alias("all"))
        .where(F.size("all") > 1)
        .select(F.array_sort("all").alias("all"))
    )
    gap = lambda x: ~x["skip"]
    groups = groups.select(
        F.filter("all", lambda x: x["skip"]).alias("skips"), F.filter("all", gap).alias("gaps"),
        F.filter("all", lambda x: x["lead"]).alias("leads"),
    )
    none = F.lit(None).cast("struct<less:long,id:long,skip:boolean,lead:boolean>")

    def other(x: Column, kind: str) -> Column:
        first = F.get(kind, F.lit(0))
        return F.when(first["id"] == x["id"], F.get(kind, F.lit(1))).otherwise(first)

    def seen(x: Column, count: Column, best: Column) -> Column:
        return F.struct(x["id"].alias("id"), count.cast("long").alias("count"), best["less"].alias("less"), best["id"].alias("near_id"))

    # the others with a skip here; and for a leading skip the gap, for the gap the leading skips
    among = F.transform("skips", lambda x: seen(x, F.size("skips") - 1, other(x, "skips")))
    across = F.transform("leads", lambda x: seen(x, F.size("gaps"), F.coalesce(F.get("gaps", F.lit(0)), none)))
    onto = F.transform("gaps", lambda x: seen(x, F.size("leads"), F.coalesce(F.get("leads", F.lit(0)), none)))
    found = groups.select(F.explode(F.concat(among, across, onto)).alias("x")).select("x.*").where("count > 0")
    best = F.min(F.struct("less", "near_id"))
    found = found.groupBy("id").agg(F.sum("count").alias("n_near"), best.alias("best"))
    return found.select("id", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near_id").alias("near_id"))


# ---------------------------------------------------------------- forms and roots

def roots(forms: DataFrame) -> DataFrame:
    """``id, root`` of a table ``id, form``: the end of each chain of forms, by pointer doubling.

    Chains do not turn in a circle, as a form is more frequent than its word.
    """
    links = materialised(forms.select("id", F.col("form").alias("root")), "forms")
    while True:
        on = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        longer = links.join(on, "root", "left")
        longer = materialised(longer.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = longer.select("id", "root")
        if longer.where("moved").isEmpty():
            return links


def spelling_variants(
    docs: DataFrame, factor: int = FACTOR, shortest: int = SHORTEST, fewest: int = FEWEST,
    id_col: str = "doc_id", text_col: str = "text", change=None,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of :func:`word_counts`.

    Near words differ by exactly one inserted, deleted or replaced code point. ``form`` is the near
    word of largest n (ties: the first by code points), if that is at least ``factor`` (2 or
    more) times the word's own, else null; ``root`` is where the chain of forms ends, the word
    itself without one. ``n_near`` counts near words, ``form_n`` is the form's n.

    Null and empty texts have no words; keys are read by ``change`` only, so null keys and
    repeated rows count like others; an empty table gives no rows; other columns are not read.
    """
    if factor < 2:
        raise ValueError("chains of forms could turn in a circle below a factor of 2")
    counts = materialised(word_counts(docs, shortest, fewest, id_col, text_col, change), "word-counts")
    forward = trie_nodes(counts, "forward-trie")
    back = trie_nodes(counts.select(F.reverse("word").alias("word"), "n"), "backward-trie")
    near = materialised(neighbours(pair_dictionary(forward, back)), "near-words")
    words = forward.select("word", "n", "id")
    found = words.join(near, "id", "left")
    forms = found.where(F.col("near_n") >= factor * F.col("n")).select("id", F.col("near_id").alias("form"))
    ends = roots(forms)
    named = lambda by, name: words.select(F.col("id").alias(by), F.col("word").alias(name))
    forms = (
        forms.join(ends.withColumnRenamed("root", "root_id"), "id")
        .join(named("form", "form_word"), "form").join(named("root_id", "root_word"), "root_id")
    )
    return found.join(forms, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("near_n")).alias("form_n"),
    )
