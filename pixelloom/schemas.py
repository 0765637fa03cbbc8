"""Tables of the engine and the limits of its values."""

from __future__ import annotations

PIXELS = "image_id long, y int, x int, r int, g int, b int, a int"
IMAGES = "image_id long, width int, height int"
PALETTE = "palette_name string, ord int, key string, name string, kind string, r int, g int, b int, tags array<string>"
INDEXED = "image_id long, y int, x int, idx int"

# Limits and enumerations.
MAX_OUTPUT_SIDE = 16_384
MAX_PIXELS = 67_108_864
MAX_SOURCE_SIDE = 32_768
MAX_FILE_BYTES = 75 * 1024 * 1024
MAX_COLORS = 256
MAX_TAGS, MAX_TAG_CHARS, MAX_NAME_CHARS = 16, 32, 64
MIME_TYPES = ("image/png", "image/jpeg", "image/webp", "image/gif")
COLOR_SPACES = ("oklab", "srgb", "linear-rgb", "weighted-rgb-601", "weighted-rgb-709", "weighted-rgb", "cielab", "oklch")
DITHERS = ("none", "bayer-2", "bayer-4", "bayer-8", "bayer-16", "random", "floyd-steinberg", "sierra", "sierra-lite")
RESIZES = ("nearest", "bilinear", "lanczos2", "lanczos3", "lanczos2-scale-aware", "lanczos3-scale-aware", "area")
ALPHA_MODES = ("preserve", "premultiplied", "matte")
KINDS = ("free", "premium", "custom", "transparent")
EPSILON = 2.220446049250313e-16
