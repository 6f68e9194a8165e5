import random
import zlib

import pytest


@pytest.fixture(scope="session")
def texts():
    """Odd and ordinary texts, with copies, near copies and a hot one."""
    rng = random.Random(5)
    sounds = "the an er in th re on at en nd ti es or te of ed is it al ar".split()
    word = lambda: "".join(rng.choice(sounds) for _ in range(rng.randint(1, 3)))
    plain = [" ".join(word() for _ in range(rng.randint(12, 90))) + "." for _ in range(60)]
    near = [" ".join([*plain[0].split()[:-1], word()]) for _ in range(5)]
    odd = [None, "", "   \n\t ", "!!! 12 ***", "a", "a\x1cb c\x0bd", "<|endoftext|> X<|startoftext|>y <|ENDOFTEXT|>.", "J̌ I'm don't 'S x'S", "½ Ⅳ １２ 3.14 “q” café CAFÉ. ẞ İ ΑΣ", "x" * 3000 + ". " + "ab" * 700, "　x y 漢字 😀!", "one two\none two\none two\nthree four five six\n" * 4, "word " * 9000]
    far = [" ".join(f"s{k} x y t{k}" for k in rng.choices(range(4), k=60)) for _ in range(6)]  # the next word depends on the third last
    return odd + far + plain + near + [plain[1]] * 30


@pytest.fixture()
def docs(spark, texts):
    """Columns in another order, and some whose names the operators use themselves."""
    rows = [("n", i, t, None if i % 7 == 0 else ("aa" if i % 2 else "bb"), 0.5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "ids string, doc_id bigint, text string, lang string, score double, start int")


@pytest.fixture()
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def remainder():
    return lambda i, m: zlib.crc32(str(i).encode()) % m
