"""Small graphs and what is known of them: edges, number of nodes, the best node and its centrality, and the trace."""

# Hand-drawn graphs and their golden numbers.

COMPONENTS3 = [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (4, 5), (4, 6), (5, 6), (5, 8), (6, 8), (6, 7)]
EXT3 = [(1, 2), (1, 7), (1, 3), (2, 4), (2, 3), (3, 4), (3, 5), (4, 6)]
TRIANGLE = [(1, 2), (1, 3), (2, 3)]
PATH7 = [(i, i + 1) for i in range(1, 7)]
PAW = [(1, 2), (2, 3), (2, 4), (3, 4)]
DIAMOND = [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
TEST18 = [
    (1, 14), (1, 15), (1, 2), (1, 3), (1, 4), (2, 5), (2, 10), (2, 9), (3, 4), (3, 5), (4, 6), (4, 7), (5, 6), (5, 9), (6, 7), (7, 8),
    (10, 12), (10, 11), (11, 12), (12, 13), (13, 17), (13, 16), (16, 17), (17, 18),
]
TEST18_FARNESS = [
    31.920635, 29.253968, 33.952381, 33.698413, 31.666667, 35.571429, 39.349206, 55.349206, 36.174603,
    33.253968, 40.587302, 37.920635, 47.920635, 47.920635, 47.920635, 57.253968, 56.587302, 72.587302,
]

#: graph -> (edges, n, best node, its centrality, trace)
KNOWN = {
    "components3": (COMPONENTS3, 8, 4, 1.422222, 4.046875),
    "ext3": (EXT3, 7, 3, 1.166667, 4.357143),
    "triangle": (TRIANGLE, 3, 1, 2.25, 0.666667),
    "path7": (PATH7, 7, 4, 0.583333, 8.0),
    "paw": (PAW, 4, 2, 1.714286, 1.583333),
    "diamond": (DIAMOND, 4, 2, 2.285714, 1.0),
    "test18": (TEST18, 18, 2, 0.615301, 21.358025),
}


def edge_table(spark, edges):
    return spark.createDataFrame([(min(e), max(e)) for e in edges], "src long, dst long")
