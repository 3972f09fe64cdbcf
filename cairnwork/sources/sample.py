"""A small C and C++ corpus of our own, as a table of files (path, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "src/main.c": """#include "engine.h"
#include <stdio.h>

int helper(int x);

int main(void) {
    start(3);
    if (helper(1)) {
        printf("start(never)");
    }
    return 0;
}
""",
    "src/engine.c": """#include "engine.h"

/* init(old) is gone */
void start(int n) {
#if defined(FAST) && LEVEL > 2
    init_fast(n);
#elif LEVEL == 1
    init_slow(n);
#else
    init(n);
#endif
#ifdef TRACE
    trace(n); // log(n)
#endif
}

static void init(int n)
{
    alloc(n);
}

int helper(int x) { return alloc(x) + 1; }
""",
    "src/pool.cpp": """#include "pool/pool.hpp"

namespace pool {
void * alloc(int n) {
    return grow(n);
}
void * grow(int n) {
#if 0
    old_grow(n);
#endif
    return malloc(n);
}
}
""",
    "include/engine.h": """#ifndef ENGINE_H
#define ENGINE_H
#define LEVEL 1
void start(int n);
int helper(int x);
#endif
""",
    "third_party/pool/pool.hpp": """#pragma once
namespace pool {
void * alloc(int n);
}
""",
}

#: The build's macros of the corpus.
MACROS = {"LEVEL": "1", "NDEBUG": ""}


def files(spark: SparkSession) -> DataFrame:
    """The corpus; written down here, so its size is fixed."""
    return spark.createDataFrame(sorted(FILES.items()), "path string, text string")
