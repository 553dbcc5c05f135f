"""The engine's tables, taken from a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The corpus with headings, contents pages, definitions and references before some documents' texts, which invented prose lacks.
AUGMENTED = """CASE
 WHEN doc_id % 17 = 3 THEN 'Table of Contents' || chr(10) || '1.1 Basic ideas ........ 4' || chr(10) || '1.2 More ideas ...... 9' || chr(10) || '1.3' || chr(10) || '2.1 Sorting ............ 17' || chr(10) || '2.2 Searching 31' || chr(10) || '2.3 Trees ..... 40' || chr(10) || 'Index ...... 99' || chr(10) || text
 WHEN doc_id % 13 = 5 THEN 'Chapter ' || CAST(doc_id % 40 + 1 AS STRING) || chr(10) || '2.1 Growing things ..... 12' || chr(10) || text
 WHEN doc_id % 11 = 2 THEN 'A gradient descent method is defined as a rule that moves toward a minimum because slopes lead down.' || chr(10) || 'Exercise 3: prove that the sum is fixed.' || chr(10) || 'Summary of key points versus overview' || chr(10) || text
 WHEN doc_id % 11 = 7 THEN 'See Smith, J. University Press (1998), vol. 3, pp. 12, Journal of Things 1999, 2001.' || chr(10) || 'Step x = y << 2 :: 12 34 56 78 90' || chr(10) || 'What is the difference of a list and a vector?' || chr(10) || text
 ELSE text END"""


#: Lines and pages that take every branch of the rules over text; invented prose takes few. They follow the documents, under ids below 0.
PROBES = [
    "Figure 3 shows the growth of the error.", "See fig. 2 for the loss curve of the model", "The value of x = y + (a * b) is $x^2$ here", "\\alpha is the step size of the method used",
    "Why does the gradient vanish when the network is deep?", "Show that the sum of two even numbers is even", "Exercise 3: compute the mean of the sample", "1 2 3 4 5 6 7 of 8",
    "red, green, blue, black, white and so on", "Kernel based methods 12 . . . 232", "Gradient Descent Methods", "The Stack And The Queue", "Binary Search Trees Are Fast", "A Short History Of Everything That Ever Was Written Down Here",
    "Gradient descent is defined as a rule that moves toward a minimum of the loss (Smith, 2020).", "Overfitting refers to a model that has learned the noise of its training data (see Chapter 3) (1999)",
    "Entropy means the mean surprise that is carried by a source", "These steps are called the forward pass and they can be repeated", "A binary heap consists of nodes that are kept in an array by levels",
    "The learning rate is the size of a step that was taken [12] (1998)", "gradient descent", "The learning rate", "moving average", "learning", "chapter overview", "neural networks used", "s curve", "what it is",
    "What is gradient descent?", "Name two kinds of trees", "Why is gradient descent slow?", "Why does the learning rate matter?", "Why do networks with 1024 units overfit?", "Why are deep networks hard to train?",
    "In practice, the method converges because steps are small", "in this section we show that the bound holds for all inputs", "it moves toward the minimum of the loss function", "deep networks overfit since they have many weights, so that data is needed",
    "therefore, the method is slow", "However, the value must not increase when the step is lower than the minimum.", "The value must increase when the step is higher.", "The value doesn't decrease; more steps never help - fewer do.",
    "and but the bullet goes on, " + "with many words that add little to it, " * 6 + "until it ends.", "x" * 250, "An af- terposition and a Title- Case pair and a verylongleftpart- verylongrightpartofaword", "ligatures: \ufb01ne \ufb02ow, di\u21b5erent \u2192 arrows \ufffd and ½ ²",
    "Some text ...... with leaders ,, and ;; signs  and  spaces", "    indented = code;", "{}(); x", "if (a == b) { return c; }", "std::vector and map<int> use Binary Search and hash_table or open-addressing",
    "Chapter 4", "Chapter 4: Sorting and Searching", "CHAPTER Seven - Graphs", "Ch. 2: Trees", "3.1 Heaps", "3.1.4 Heap order", "Section 2.3: Queues", "§ 4.5 Stacks", "4.2", "Chapter 2: Lists ...... 45", "3. Trees ..... 61", "5 Graphs 77",
    "Chapter 1 Solutions", "Answers", "Solutions to Exercises", "Answer Key", "Chapter 3 Summary", "Review Questions", "Practice Problems", "1. The correct answer is (B).", "Compare a stack and a queue", "What is the difference between lists and arrays?",
    "A stack is not a queue and it never was; the order of a queue is first in first out.", "term 12, 45, 89 and other 3-5, 7", "(1.2) x = 3", "α and β are rates", "[3] (2001) two marks", "  \t ", "ends with a number 42",
    "Table of Contents\n1.1 Basic ideas ........ 4\n1.2 More . . . . . 9\nkept line\n\n\n\nlast line.  \r\nmore",
    "Chapter 9\nTrees\nA tree is a graph without cycles. It has nodes and edges that join them in one piece. Every tree of n nodes has n - 1 edges.\n" * 3,
    "9.1\nBalanced trees\n" + "A balanced tree keeps its height small. This makes every search fast and cheap for users of the tree. " * 5,
    "Preface\nAll rights reserved. Published by nobody at all.\n" + "This book is about trees and graphs and nothing else at all here. " * 8, "Subject Index\n" + "\n".join(f"term{k} {k}, {k + 2}, {k + 9}" for k in range(40)),
    "Practice Problems\n" + "\n".join(f"{k}. What is the value of item {k} in the list of all items?\n(A) one\nB) two" for k in range(1, 9)), "A blank page\n",
    "Table of Contents\n" + "\n".join(f"{k}.1 Title of part {k} ........ {k * 7}" for k in range(1, 14)) + "\n2.1\n2.2\n2.3\n2.4\n2.5\n2.6",
    "The first clause is long enough to count as a sentence here; the second clause is also long enough; " * 4 + "A short one. Yes — it is: This part stands after a colon and is a sentence of its own • so is this bullet of many words",
    "word " * 90 + "end of it, then a tail of some more words that stays", "Example 10: the heap holds the least key at its root always. hyphen-\nated words are joined again by the cleaner now.",
    "Gradient descent is defined as an iterative optimization procedure following negative slopes until convergence. Gradient descent refers to repeated small steps that lower training loss along measured slopes. "
    "Binary trees are called ordered structures whenever every left child holds smaller keys than right children. Stochastic sampling means drawing random training examples during every optimization step taken.",
    "Deep networks overfit small datasets because their weights memorize random noise patterns quickly. Sparse linear models can generalize well since fewer active weights limit memorized noise patterns. "
    "Very large batches use much more memory, therefore training uses several machines with shared gradients. In practice, smooth convex losses are much easier targets because every local minimum is also global.",
]


def with_probes(df: DataFrame, *more: str) -> DataFrame:
    """df (doc_id, ..., s) and the probes as further rows; more: SQL of the columns between."""
    rows = df.sparkSession.createDataFrame([(-1 - k, s) for k, s in enumerate(PROBES)], "doc_id long, s string")
    return df.unionByName(rows.selectExpr("doc_id", *more, "s"))


def probe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, s): the lines of the augmented documents and of the probes."""
    lined = F.posexplode(F.split("s", "\n")).alias("pos", "s")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(AUGMENTED).alias("s"))
    return with_probes(docs).select("doc_id", lined)


def probe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, s): the augmented documents and the probes as pages."""
    return with_probes(table(spark, sf_dir, "documents").select("doc_id", F.expr(AUGMENTED).alias("s")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as library chunks with pages."""
    start = F.col("doc_id") % 400 + 1
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("book"), F.col("lang").alias("section"),
        (F.col("doc_id") % 12 + 1).cast("int").alias("chapter"), start.alias("page_start"), (start + F.expr("n_chars div 2000")).alias("page_end"), F.expr(AUGMENTED).alias("text"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, s): the lines of the augmented documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.expr(AUGMENTED), "\n")).alias("pos", "s"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as card reviews: user_id, card_id, ts, quality."""
    quality = F.expr("CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("card_id"), "ts", quality.alias("quality"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as study cards with a review state that follows from the key."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("card_id"), F.col("p_brand").alias("book"), F.col("p_type").alias("tag"), F.col("p_name").alias("prompt"),
        (k % 45).cast("int").alias("interval_days"), (F.lit(1.3) + (k % 18) / 10).alias("ease"), (k % 6).cast("int").alias("reps"), (k % 4).cast("int").alias("lapses"),
        F.when(k % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 120).cast("int"))).alias("last_reviewed"),
        F.date_add(F.lit("2024-03-01").cast("date"), (k % 90).cast("int")).alias("due_date"),
    )
