"""The four clustering pipelines, and the methods that the graph pipeline can use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import colour
from ..operators import association, density, graph, raster, visibility, voting
from ..operators.overlay import bright
from ..session import settled


def _nodes(line_mask: DataFrame) -> DataFrame:
    return line_mask.select(F.col("line3d_id").alias("id")).distinct()


def whispers(line_mask: DataFrame, required_views: int = 3) -> DataFrame:
    kept = graph.kept_masks(line_mask)
    return graph.label_propagation(_nodes(kept), graph.kept_cooccurrence(kept, required_views))


def leiden(line_mask: DataFrame, required_views: int = 3) -> DataFrame:
    kept = graph.kept_masks(line_mask)
    return graph.leiden(_nodes(kept), graph.kept_cooccurrence(kept, required_views))


def leiden_normalised(line_mask: DataFrame, required_views: int = 3) -> DataFrame:
    kept = graph.kept_masks(line_mask)
    return graph.leiden(_nodes(kept), graph.normalised(graph.kept_cooccurrence(kept, required_views), kept))


def similarity_density(line_mask: DataFrame, required_views: int = 3, min_cluster_size: int = 5) -> DataFrame:
    """Density clusters of co-occurrence distances with one sample a core; noise stays alone.

    Lines that share too few views are all as far apart as a weight of zero says.
    """
    kept = graph.kept_masks(line_mask)
    edges, nodes = settled(graph.kept_cooccurrence(kept, required_views)), settled(_nodes(kept))
    far = (edges.agg(F.max("weight")).first()[0] or 0) + 1e-6
    labels = density.density_clusters(settled(density.similarity_distance(edges)), min_cluster_size, 1, nodes, far)
    return density.clusters_of(labels, nodes, keep_noise=True)


def walks_density(line_mask: DataFrame, required_views: int = 3, walks: int = 200, length: int = 30, dim: int = 64, seed: int = 1) -> DataFrame:
    """Random walks, word vectors of them, and density clusters of the vectors; noise stays alone."""
    kept = graph.kept_masks(line_mask)
    edges = settled(graph.kept_cooccurrence(kept, required_views))
    linked = settled(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    if not linked.limit(1).count():
        return _nodes(kept).select(F.col("id").alias("cluster_id"), F.col("id").alias("member_id"))
    text = settled(graph.random_walks(linked, edges, walks, length, seed).select(F.transform("path", lambda x: x.cast("string")).alias("path")))
    model = Word2Vec(vectorSize=dim, windowSize=10, minCount=1, seed=seed, numPartitions=8, inputCol="path", outputCol="v").fit(text)
    vectors = settled(model.getVectors().select(F.col("word").cast("long").alias("id"), vector_to_array("vector").alias("v")))
    labels = density.density_clusters(settled(density.embedded_neighbours(vectors)), 5, 3, vectors.select("id"))
    return density.clusters_of(labels, _nodes(kept), keep_noise=True)


def drawn(clusters: DataFrame, lines: DataFrame) -> DataFrame:
    """(cluster_id, member_id, both ends, red, green, blue): what a viewer of clusters shows."""
    red, green, blue = colour(F.col("cluster_id"))
    rows = clusters.join(lines.withColumnRenamed("line3d_id", "member_id"), "member_id")
    return rows.select("cluster_id", "member_id", "x1", "y1", "z1", "x2", "y2", "z2", red.alias("red"), green.alias("green"), blue.alias("blue"))


#: The grey of noise, and the opacity of noise and of clusters.
NOISE_GREY, NOISE_ALPHA, CLUSTER_ALPHA = 128, 0.3, 0.7


def projected_clusters(projected: DataFrame, clusters: DataFrame) -> DataFrame:
    """(line3d_id, cluster_id, x1, y1, x2, y2, red, green, blue, alpha): what a plot of lines on the ground shows; noise is cluster -1 and grey."""
    own = projected.join(clusters.select(F.col("member_id").alias("line3d_id"), "cluster_id"), "line3d_id", "left")
    noise = F.col("cluster_id").isNull()
    shades = [F.when(noise, NOISE_GREY).otherwise(c).alias(n) for c, n in zip(bright(F.col("cluster_id")), ("red", "green", "blue"))]
    return own.select("line3d_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), "x1", "y1", "x2", "y2", *shades, F.when(noise, NOISE_ALPHA).otherwise(CLUSTER_ALPHA).alias("alpha"))


def plane_of_vectors(vectors: DataFrame) -> DataFrame:
    """(id, u, v): vectors (id, v: array of doubles) on their two directions of most variance, around the mean.

    The covariance is summed by Spark; the driver holds a square of the number of dimensions. The largest
    weight of a direction is positive. A plane by neighbourhoods instead of variance has no counterpart here.
    """
    rows = settled(vectors.select("id", array_to_vector("v").alias("at")))
    model = PCA(k=2, inputCol="at", outputCol="to").fit(rows)
    mean = rows.select(Summarizer.mean(F.col("at")).alias("m")).first().m.toArray()
    ways = model.pc.toArray()
    ways = ways * [1 if w[abs(w).argmax()] > 0 else -1 for w in ways.T]
    at = vector_to_array("at")
    part = lambda k: F.aggregate(F.zip_with(at, F.array(*(F.lit(float(w)) for w in ways[:, k])), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) - float(mean @ ways[:, k])
    return rows.select("id", part(0).alias("u"), part(1).alias("v"))


METHODS: dict[str, Callable[..., DataFrame]] = {
    "maximum": graph.strict_clusters,
    "whispers": whispers,
    "leiden": leiden,
    "leiden_normalised": leiden_normalised,
    "walks_density": walks_density,
    "similarity_density": similarity_density,
}


def clusters_by(method: str, line_mask: DataFrame, **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"no method {method!r}; there are {', '.join(sorted(METHODS))}")
    return METHODS[method](line_mask, **options)


def projected_line_mask(views: DataFrame, mask_pixels: DataFrame, height: int, width: int, places: DataFrame | None = None) -> DataFrame:
    """(cam_id, line3d_id, mask_id) by the majority of the pixels that a visible line's projection covers.

    Masks are those of each view, or with ``places`` (cam_id, place) those of each place (place, row, col, mask_id), which no view copies.
    """
    line = F.struct("cam_id", "line3d_id").alias("seg_id")
    ends = ("y1", "x1", "y2", "x2")
    if places is not None:
        views = views.join(places, "cam_id").select(F.col("place").alias("cam_id"), line, *ends)
        mask_pixels = mask_pixels.withColumnRenamed("place", "cam_id")
    else:
        views = views.select("cam_id", line, *ends)
    pixels = raster.raster_pixels(views, height, width)
    on = pixels.join(mask_pixels, ["cam_id", "row", "col"], "left").withColumn("mask_id", F.coalesce("mask_id", F.lit(raster.BACKGROUND)))
    return raster.majority_mask(on, "seg_id", background=True).select("seg_id.cam_id", "seg_id.line3d_id", "mask_id")


def graph_pipeline(residuals: DataFrame, seg_mask: DataFrame, lines: DataFrame, cameras: DataFrame, observed: DataFrame, mask_pixels: DataFrame, size: tuple[int, int], method: str = "maximum", **options) -> DataFrame:
    """Direct and projected line masks, clustered by one of the methods."""
    projected = projected_line_mask(visibility.visible_lines(lines, cameras, observed), mask_pixels, *size)
    line_mask = settled(association.full_line_mask(association.direct_line_mask(residuals, seg_mask), projected))
    return clusters_by(method, line_mask, **options)


def voting_pipeline(residuals: DataFrame, seg_mask: DataFrame, tracks: DataFrame, k: int = 10) -> DataFrame:
    near = association.neighbours(association.view_overlap(tracks), k)
    votes = settled(voting.votes_cast(residuals, seg_mask, near))
    return voting.voting_clusters(residuals, seg_mask, voting.mask_components(voting.mask_edges(votes)))


def distance_pipeline(lines: DataFrame, min_cluster_size: int = 10, min_samples: int | None = None, reach: float = 1.0) -> DataFrame:
    """Density clusters of lines by their distance on the ground, noise left out; ``reach`` is the first radius tried."""
    labels = density.planar_clusters(density.ground_projection(lines), min_cluster_size, min_samples, reach)
    return density.clusters_of(labels, lines.select(F.col("line3d_id").alias("id")), keep_noise=False)
