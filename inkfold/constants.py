"""Fixed values of the board formats. Results depend on them, so each is stated once."""

# Tracing: alpha from which a sample is traced, floor of the faint layer, opacity that the faint layer is drawn with.
TRACEABLE_ALPHA = 96
VECTOR_FLOOR_ALPHA = 88
FAINT_OPACITY = 64
# Shares of samples below full alpha: up to the first an image stays raster, from the second it's traced.
RASTER_TRANSPARENCY = 0.01
TRACE_TRANSPARENCY = 0.02
COLOR_STEP = 32
# Components: untraced share of ink, half coverage, width of thin strokes, least peak of a pen stroke.
UNTRACED_INK = 0.25
HALF_COVERAGE = 128
THIN_WIDTH = 3
RECONSTRUCTION_PEAK = 48
# Highlighters: sides of 4 to 1, channel spread of 28, 19 of 20 visible samples.
HIGHLIGHTER_ASPECT = 4
HIGHLIGHTER_CHROMA = 28
# Contours.
TOLERANCE_SQUARED = 0.25
COLLINEAR = 1e-9
POINT_LIMIT = 500_000
SUPERSAMPLING = 4
FIELD_TILE = 16
FIELD_MARGIN = 3
HISTOGRAM_BINS = 5120
BIN_WIDTH = 0.0625
CORNER_COSINE = -0.5
RECONSTRUCTION_LEVEL = 0.6
NORMALIZATION_RADIUS = 3
NORMALIZED_FLOOR = 24
# Comparison of renderings.
MEAN_LIMIT = 0.02
WITHIN_LIMIT = 0.96
INK_LIMITS = (0.85, 1.15)
PIXEL_TOLERANCE = 32
REGION_SIDE = 32
REGIONS = 3
SCALE_DPIS = (18, 72)
DETAIL_DPIS = (288, 576)
CAPTURE_WIDTH, CAPTURE_HEIGHT = 8192, 4096
UNITS_PER_INCH = 72
# Scenes.
COVERAGE_TOLERANCE = 1e-9
SIMILARITY_TOLERANCE = 1e-9
# Sources.
IGNORED_FOLDERS = (".git", "build", "dist", "dist.building", "dist.previous", "dist-newstyle", "node_modules")
SVG_NAMESPACE = "http://www.w3.org/2000/svg"
XHTML_NAMESPACE = "http://www.w3.org/1999/xhtml"
XLINK_NAMESPACE = "http://www.w3.org/1999/xlink"
# CSS pixels of each absolute unit, 96 to the inch.
PIXELS_PER_UNIT = {"": 1.0, "px": 1.0, "pt": 96 / 72, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4}
