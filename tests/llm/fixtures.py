"""Documents with every awkward case."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor int, size string, copies int, _row string"


def rows():
    long = " ".join(f"word{i % 977} of" for i in range(9000))
    texts = [
        None, "", " \n\t ", "one", "one two", "ONE two", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p",
        "a b c d e f g h i j k l m n o q", long, long + " end", "line one is here\nline one is here\nline two", "x" * 500,
        "mail me.Now@host.example.com or +1 (555) 010-2030 now", "mail ME.now@host.example.com or +1 555 010-2030 now",
        "Mrs. Anna Miller met Mr. Miller at 10.20.30.40, card 4111 1111 1111 1111", "ключ Госпожа Иванова пришла",
        "ünï cödé 漢字 \U0001f600 text", "<|turn|> </s>[INST] \\ \\\\ <\\|", "the cat sat on the mat " * 20,
    ]
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None, 1, "z", 2, "r") for i, t in enumerate(texts)]
    return [*out, (None, "no id here", None, None, None, None, None, None, None), (None, "no id here", None, None, None, None, None, None, None), out[6], out[6]]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
