"""Tokens of symbol strings: pair-merge vocabularies, longest-match encoding, special tokens, padding and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.operators.lineage import cut

#: The ids of special tokens.
SPECIALS = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "<mask>": 4}
SEP = "\u0001"


def adjacent_pairs(seqs: DataFrame, weight: str | None = None) -> DataFrame:
    """(left, right, n, first_row, first_at): adjacent tokens of (row_id, toks), overlapping ones too; n sums weights, if there are."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("toks") - 2), lambda i: F.struct(i.alias("at"), F.get("toks", i).alias("left"), F.get("toks", i + 1).alias("right")))
    one = seqs.where("size(toks) >= 2").select("row_id", F.explode(pairs).alias("p"), *[weight] * bool(weight))
    n = F.sum(weight) if weight else F.count("*")
    out = one.groupBy("p.left", "p.right").agg(n.alias("n"), F.min(F.struct("row_id", "p.at")).alias("first"))
    return out.select("left", "right", "n", F.col("first.row_id").alias("first_row"), F.col("first.at").alias("first_at"))


def train_merges(seqs: DataFrame, max_vocab: int, min_freq: int, max_pieces: int, cut_every: int = 4) -> list[str]:
    """The vocabulary of `train_merges_counted`, without frequencies."""
    return list(train_merges_counted(seqs, max_vocab, min_freq, max_pieces, cut_every))


def train_merges_counted(seqs: DataFrame, max_vocab: int, min_freq: int, max_pieces: int, cut_every: int = 4) -> dict[str, int]:
    """The vocabulary in first-seen order, with frequencies: base tokens of (row_id, toks), then merges of the most frequent pair, the earliest on ties.

    A merge adds the pair's count to its token and takes it from both parts, down to 0; no token goes. A pair's count has
    occurrences that overlap, so it can exceed the merges made.

    Equal sequences are one row with a weight and the first row's id. One aggregation a round reaches the driver as one
    row; the sequences stay distributed, and their lineage is cut every few rounds.
    """
    base = seqs.select("row_id", F.posexplode("toks").alias("at", "tok")).groupBy("tok").agg(F.min(F.struct("row_id", "at")).alias("first"), F.count("*").alias("n")).orderBy("first").select("tok", "n").collect()
    vocab = {r["tok"]: r["n"] for r in base}
    if not vocab:
        raise ValueError("the corpus has no well-formed sequence")
    size = dict.fromkeys(vocab, 1)
    now = cut(seqs.where("size(toks) > 1").groupBy("toks").agg(F.min("row_id").alias("row_id"), F.count("*").alias("weight")))
    turn = 0
    while len(vocab) < max_vocab:
        fit = adjacent_pairs(now, "weight")
        long = [t for t, n in size.items() if n > 1]
        if long:  # tokens of one piece always fit
            pieces = F.create_map(*[F.lit(x) for t in long for x in (t, size[t])])
            fit = fit.where(F.coalesce(F.try_element_at(pieces, "left"), F.lit(1)) + F.coalesce(F.try_element_at(pieces, "right"), F.lit(1)) <= max_pieces)
        best = fit.orderBy(F.desc("n"), "first_row", "first_at").limit(1).collect()
        if not best or best[0]["n"] < min_freq:
            break
        left, right = best[0]["left"], best[0]["right"]
        size.setdefault(left + right, size[left] + size[right])
        vocab[left + right] = vocab.get(left + right, 0) + best[0]["n"]
        for part in (left, right):
            vocab[part] = max(0, vocab[part] - best[0]["n"])
        now = now.withColumn("toks", merged("toks", left, right)).where("size(toks) > 1")
        turn += 1
        if turn % cut_every == 0:
            now = cut(now)
    return vocab


def merged(toks: str, left: str, right: str) -> Column:
    """Every left-to-right, non-overlapping occurrence of the pair becomes one token."""
    return F.aggregate(
        toks,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == right) & (F.get(acc, F.size(acc) - 1) == left) & (F.size(acc) > 0), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.lit(left + right)))).otherwise(F.concat(acc, F.array(x))),
    )


def vocabulary(spark: SparkSession, tokens: list[str]) -> DataFrame:
    """(token, id): specials first, then from 5 in the order given, each once."""
    order = [*SPECIALS, *dict.fromkeys(t for t in tokens if t not in SPECIALS)]
    return spark.createDataFrame([(t, i) for i, t in enumerate(order)], "token string, id int")


#: The form of a symbol that may be forced into a vocabulary; ids of special tokens stand first.
SYMBOL = r"^\[[^\[\]\s]+\]$"


def patched(vocab: DataFrame, extra: DataFrame) -> DataFrame:
    """(token, id, added): a vocabulary (token, id) and the symbols of extra (token) that it lacks, behind its largest id, in order of text.

    Symbols come once, whatever the number of their rows; a null or a symbol that isn't one bracket is an error when rows
    are read. Nothing that is there changes its id.
    """
    wrong = F.coalesce(~F.col("token").rlike(SYMBOL), F.lit(True))
    asked = extra.select(F.when(wrong, F.raise_error(F.concat(F.lit("malformed symbol: "), F.coalesce("token", F.lit("null"))))).otherwise(F.col("token")).alias("token")).distinct()
    new = asked.join(vocab, "token", "left_anti")
    last = vocab.agg(F.coalesce(F.max("id"), F.lit(len(SPECIALS) - 1)).alias("last"))
    # vocabularies are small: one window over the symbols that are new
    numbered = new.join(F.broadcast(last)).select("token", (F.col("last") + F.row_number().over(Window.orderBy("token"))).cast("int").alias("id"), F.lit(True).alias("added"))
    return vocab.select("token", F.col("id").cast("int").alias("id"), F.lit(False).alias("added")).unionByName(numbered)


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(token, id_a, id_b, status) of the tokens in which two vocabularies (token, id) differ: only_a, only_b or other_id. Equal ones give no row."""
    left, right = a.select("token", F.col("id").alias("id_a"), F.lit(True).alias("__a")), b.select("token", F.col("id").alias("id_b"), F.lit(True).alias("__b"))
    status = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").when(~F.col("id_a").eqNullSafe(F.col("id_b")), "other_id")
    return left.join(right, "token", "full").select("token", "id_a", "id_b", status.alias("status")).where("status IS NOT NULL")


def compared_ids(df: DataFrame, a: str, b: str) -> DataFrame:
    """df's rows whose two tokenisations differ, with first_difference: the first place at which they do."""
    place = F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i))))
    return df.where(~F.col(a).eqNullSafe(F.col(b))).withColumn("first_difference", F.when(F.col(a).isNull() | F.col(b).isNull(), 0).otherwise(place))


def detokenised(ids: Column, vocab: dict[str, int], skip_special: bool = True) -> Column:
    """The tokens of ids joined; ids outside the vocabulary are the unknown token. Special tokens are left out if asked."""
    names = F.create_map(*[F.lit(x) for t, i in vocab.items() for x in (i, t)])
    special = F.array(*[F.lit(i) for i in SPECIALS.values()])
    kept = F.filter(ids, lambda x: ~F.array_contains(special, x)) if skip_special else ids
    return F.array_join(F.transform(kept, lambda x: F.coalesce(F.try_element_at(names, x), F.lit("<unk>"))), "")


def encode(text: Column, vocab: dict[str, int], max_span: int) -> Column:
    """Ids by greedy longest match over bracketed symbols: one regular expression, longest tokens first; malformed text is one unknown."""
    import re

    known = sorted((t for t in vocab if t.startswith("[")), key=lambda t: (-t.count("["), t))
    pattern = "(" + "|".join([re.escape(t).replace("/", "\\/") for t in known if t.count("[") <= max_span] + [r"\[[^\]]+\]"]) + ")"
    ids = F.create_map(*[F.lit(x) for kv in vocab.items() for x in kv])
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    good = (F.array_join(found, "") == text) & (F.length(text) > 0)
    unknown = F.lit(SPECIALS["<unk>"])
    return F.when(good, F.transform(found, lambda t: F.coalesce(F.try_element_at(ids, t), unknown))).otherwise(F.array(unknown))


def encode_pieces(pieces: Column, vocab: dict[str, int], max_span: int) -> Column:
    """Ids by greedy longest match over pieces, tokens of up to max_span of them; a piece that begins no token is unknown, no pieces are one unknown.

    For vocabularies whose tokens aren't told apart by brackets: a fold over places, which looks up the joined pieces from
    the longest on. The vocabulary is a literal of the plan.
    """
    ids = F.create_map(*[F.lit(x) for kv in vocab.items() for x in kv])
    unknown = SPECIALS["<unk>"]

    def at(all_: Column, i: Column) -> Column:
        spans = F.filter(F.sequence(F.lit(1), F.least(F.lit(max_span), F.size(all_) - i)), lambda k: F.map_contains_key(ids, F.array_join(F.slice(all_, i + 1, k), "")))
        return F.coalesce(F.array_max(spans), F.lit(0))

    def step(all_: Column):
        def one(s: Column, i: Column) -> Column:
            took = F.transform(F.array(at(all_, i)), lambda k: F.struct((i + F.greatest(k, F.lit(1))).alias("next"), F.concat(s["ids"], F.array(F.when(k == 0, unknown).otherwise(F.try_element_at(ids, F.array_join(F.slice(all_, i + 1, F.greatest(k, F.lit(1))), ""))))).alias("ids")))[0]
            return F.when(i < s["next"], s).otherwise(took)

        return one

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("ids"))
    folded = F.transform(F.array(pieces), lambda all_: F.aggregate(F.sequence(F.lit(0), F.size(all_) - 1), start, step(all_), lambda s: s["ids"]))[0]
    return F.when(F.size(pieces) > 0, folded).otherwise(F.array(F.lit(unknown)))


def framed(ids: Column, pair: Column | None = None) -> Column:
    """ids between start and end; a second sequence follows behind the end, with an end of its own."""
    end = F.array(F.lit(SPECIALS["</s>"]))
    return F.concat(F.array(F.lit(SPECIALS["<s>"])), ids, end, *([pair, end] if pair is not None else []))


def truncated(ids: Column, length: int, how: str) -> Column:
    """framed ids cut to a length: `cut` loses the end token, `content` keeps both ends, `last` keeps the last id."""
    if how == "cut":
        return F.slice(framed(ids), 1, length)
    if how == "content":
        return framed(F.slice(ids, 1, length - 2))
    whole = framed(ids)
    return F.when(F.size(whole) > length, F.concat(F.slice(whole, 1, length - 1), F.slice(whole, -1, 1))).otherwise(whole)


def padded(ids: Column, length: Column, pad: int = SPECIALS["<pad>"]) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0))))


def padded_batches(df: DataFrame, batch: str, ids: str = "ids", labels: str | None = None, length: int | None = None, multiple: int = 1, left: bool = False) -> DataFrame:
    """df with ids padded to the longest of their batch, or to `length`, rounded up to a multiple; labels are padded by -100; on the right, or on the left.

    Nothing is cut: a row longer than that stays. Only lengths are shuffled, not rows, to find the longest of a batch.
    """
    if multiple < 1:
        raise ValueError("multiple must be 1 or more")
    if length is None:
        longest = df.groupBy(F.col(batch).alias("__batch")).agg(F.max(F.size(ids)).alias("__longest"))
        rows = df.join(longest, F.col(batch).eqNullSafe(F.col("__batch"))).drop("__batch")
    else:
        rows = df.withColumn("__longest", F.lit(length))
    target = (F.ceil(F.col("__longest") / multiple) * multiple).cast("int")

    def filled(c: str, value: int) -> Column:
        more = F.array_repeat(F.lit(value), F.greatest(target - F.size(c), F.lit(0)))
        return F.concat(more, F.col(c)) if left else F.concat(F.col(c), more)

    out = {ids: filled(ids, SPECIALS["<pad>"])} | ({labels: filled(labels, -100)} if labels else {})
    return rows.withColumns(out).drop("__longest")


def token_statistics(df: DataFrame, ids: str, max_length: int) -> DataFrame:
    """One row on framed, untruncated ids: sample_size, mean_len, p50_len, p95_len, p99_len (nearest ranks), max_len, truncation_rate, unk_rate, empty_sequence_rate, mostly_unknown_rate.

    Lengths are those after truncation, of rows that have ids; percentiles come from counts by length, of which there are
    no more than max_length. unk_rate is over the places of truncated rows that may be masked; a row in which more than
    80 % of them are unknown is mostly unknown. A null row counts as empty. No rows with ids give nulls, no rows nothing.
    """
    kept = truncated_raw(F.col(ids), max_length)
    may = eligible(kept)
    unknown = F.size(F.filter(may, lambda x: x == SPECIALS["<unk>"]))
    n = F.coalesce(F.size(ids), F.lit(0))
    rows = df.select(n.alias("n"), F.least(n, F.lit(max_length)).alias("len"), F.coalesce(F.size(may), F.lit(0)).alias("may"), F.coalesce(unknown, F.lit(0)).alias("unk"))
    full = rows.where("n > 0")
    by_length = full.groupBy("len").agg(F.count("*").alias("rows"))
    upto = by_length.withColumn("upto", F.sum("rows").over(Window.orderBy("len"))).withColumn("all", F.sum("rows").over(Window.partitionBy()))

    def rank(q: float) -> Column:
        return F.min(F.when(F.col("upto") > F.bround((F.col("all") - 1) * F.lit(q), 0), F.col("len"))).cast("double")

    ranks = upto.agg(*[rank(q).alias(f"p{round(q * 100)}_len") for q in (0.5, 0.95, 0.99)])
    size = F.count("*")
    facts = rows.agg(
        size.alias("sample_size"), F.avg(F.when(F.col("n") > 0, F.col("len"))).alias("mean_len"), F.max(F.when(F.col("n") > 0, F.col("len"))).cast("double").alias("max_len"),
        (F.sum((F.col("n") > max_length).cast("long")) / size).alias("truncation_rate"), (F.sum("unk") / F.greatest(F.lit(1), F.sum("may"))).alias("unk_rate"),
        (F.sum((F.col("n") == 0).cast("long")) / size).alias("empty_sequence_rate"), (F.sum((F.col("unk") > 0.8 * F.col("may")).cast("long")) / size).alias("mostly_unknown_rate"),
    ).where("sample_size > 0")
    order = ["sample_size", "mean_len", "p50_len", "p95_len", "p99_len", "max_len", "truncation_rate", "unk_rate", "empty_sequence_rate", "mostly_unknown_rate"]
    return facts.join(F.broadcast(ranks)).select(*order)


def truncated_raw(ids: Column, length: int) -> Column:
    """Framed ids cut to a length that keep their end token."""
    return F.when(F.size(ids) > length, F.concat(F.slice(ids, 1, length - 1), F.slice(ids, -1, 1))).otherwise(ids)


#: Limits of the quality gates; truncation only warns.
GATES = {"unk_rate": 0.001, "empty_sequence_rate": 0.0, "mostly_unknown_rate": 0.01, "truncation_rate": 0.05}
LEAST_VOCABULARY, LEAST_BRACKETED = 100, 0.95


def quality_gates(statistics: DataFrame, vocab: DataFrame, samples: DataFrame, sequence: str, sha256: str | None = None, recorded: str | None = None, limits: dict[str, float] | None = None) -> DataFrame:
    """(gate, value, allowed, severity, passed): whether a vocabulary (token, id) may be trained with.

    Gates: vocabulary_size, special_ids (how many of them stand elsewhere), sha256 (1 if the file's isn't the recorded
    one; nothing recorded passes), bracketed (share of samples that are bracketed symbols alone), and the rates of
    `token_statistics`, which fail above their limit. severity is error or, for truncation, warning. Without samples
    every rate is null and fails.
    """
    from lodeweave.functions import text

    limits = GATES | (limits or {})
    wanted = F.create_map(*[F.lit(x) for kv in SPECIALS.items() for x in kv])
    # a count over the vocabulary; tokens it lacks count as standing elsewhere
    right = F.sum((F.try_element_at(wanted, F.col("token")) == F.col("id")).cast("long"))
    v = vocab.agg(F.count("*").cast("double").alias("vocabulary_size"), (len(SPECIALS) - F.coalesce(right, F.lit(0))).cast("double").alias("special_ids"))
    good = F.coalesce(text.well_formed(F.col(sequence), text.BRACKETED) & (F.length(sequence) > 0), F.lit(False))
    b = samples.agg(F.avg(good.cast("double")).alias("bracketed"))
    off = 0.0 if not recorded or recorded == sha256 else 1.0
    one = v.join(F.broadcast(b)).join(F.broadcast(statistics.select(*limits)), how="left").withColumn("sha256", F.lit(off))
    rules = [("vocabulary_size", float(LEAST_VOCABULARY), ">=", "error"), ("special_ids", 0.0, "<=", "error"), ("sha256", 0.0, "<=", "error"), ("bracketed", LEAST_BRACKETED, ">=", "error")]
    rules += [(g, float(limit), "<=", "warning" if g == "truncation_rate" else "error") for g, limit in limits.items()]
    made = [F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("value"), F.lit(limit).alias("allowed"), F.lit(severity).alias("severity"), F.coalesce(F.col(g) >= limit if how == ">=" else F.col(g) <= limit, F.lit(False)).alias("passed")) for g, limit, how, severity in rules]
    return one.select(F.explode(F.array(*made)).alias("g")).select("g.*")


def eligible(ids: Column) -> Column:
    """Ids that may be masked: all but start, padding, end and mask; unknowns may."""
    skip = F.array(*[F.lit(SPECIALS[t]) for t in ("<s>", "<pad>", "</s>", "<mask>")])
    return F.filter(ids, lambda x: ~F.array_contains(skip, x))


def nearest_rank(sorted_values: Column, q: float) -> Column:
    """The value at round((n - 1) q), halves to even."""
    return F.get(sorted_values, F.bround((F.size(sorted_values) - 1) * F.lit(q), 0).cast("int"))


def length_counts(df: DataFrame, n: str) -> DataFrame:
    """(n, upto): how many rows have a length up to n, for exact percentiles without gathering rows."""
    c = df.groupBy(n).agg(F.count("*").alias("rows"))
    return c.withColumn("upto", F.sum("rows").over(Window.orderBy(n).rowsBetween(Window.unboundedPreceding, 0)))
