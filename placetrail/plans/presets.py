"""Named settings of the revisit detection: one parameterised engine, nineteen presets."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Preset:
    """How frames are matched, decided, numbered and reported.

    A pair matches if ``min_part * limit < d <= limit`` (no lower bound where ``min_part`` is None). A frame is reported
    if its belief count exceeds ``more_than``. ``warmup`` says where the first three frames of a chunk enter the database
    without a test: per_chunk, first_chunk or none. An image number is ``(base + chunk) * stride + i``, halved half-even
    if ``halve``; with ``offsets`` it is ``i + offset`` of the chunk, halved and truncated (raw where the offset is None).
    """

    norm: str = "l2"
    limit: float = 1.25
    min_part: float | None = None
    k_run: int = 3
    more_than: int = 0
    warmup: str = "per_chunk"
    chunk_size: int = 100
    chunk_mode: str = "inclusive"
    drop_partial: bool = True
    base: int = 0
    stride: int = 100
    halve: bool = False
    offsets: tuple[int | None, ...] | None = None
    report: str = "a"
    chunks_scanned: int | None = None
    excluded_chunks: tuple[int, ...] = ()

    def but(self, **changes) -> Preset:
        return replace(self, **changes)


#: The published settings of each sequence and network, in the order sequence, network.
PRESETS: dict[str, Preset] = {
    "gazebo_vgg16_adapted": Preset(
        limit=2.1, chunk_size=221, base=1, offsets=(None, 221, 441, 661), report="c", chunks_scanned=4
    ),
    "kitti05_alexnet": Preset(limit=60, base=1, chunk_mode="half_open", drop_partial=False, report="b", chunks_scanned=55),
    "kitti05_convnext": Preset(limit=24, base=1, chunk_size=50, stride=50, report="b", chunks_scanned=103),
    "kitti05_resnet": Preset(norm="linf", limit=0.25, base=1, halve=True, chunks_scanned=54),
    "kitti05_vgg16_adapted": Preset(limit=4, base=1, chunk_size=200, stride=200, halve=True, report="b", chunks_scanned=27),
    "kitti05_vgg16": Preset(limit=38, halve=True, report="b", chunks_scanned=55),
    "kitti05_vit": Preset(limit=15, chunk_size=25, stride=25, halve=True, report="b", chunks_scanned=193),
    "kitti08_alexnet": Preset(
        limit=25, base=1, stride=50, chunk_mode="half_open", drop_partial=False, report="b", chunks_scanned=82
    ),
    "kitti08_convnext": Preset(norm="linf", limit=1.8, chunk_size=50, stride=50, halve=True, report="b", chunks_scanned=143),
    "kitti08_resnet": Preset(norm="linf", limit=5.8, halve=True, chunks_scanned=81),
    "kitti08_vgg16_adapted": Preset(limit=4.5, base=1, chunk_size=200, stride=200, halve=True, report="b", chunks_scanned=37),
    "kitti08_vgg16": Preset(limit=4.5, base=1, stride=200, halve=True, report="b", chunks_scanned=37),
    "kitti08_vit": Preset(limit=19, chunk_size=25, stride=25, halve=True, report="b", chunks_scanned=157),
    "tum_alexnet": Preset(limit=220, base=1, chunks_scanned=83),
    "tum_convnext": Preset(norm="linf", limit=6, k_run=200, chunk_size=50, stride=50, chunks_scanned=156),
    "tum_resnet": Preset(norm="linf", limit=0.24, chunks_scanned=83),
    "tum_vgg16_adapted": Preset(
        limit=9, min_part=2 / 3, more_than=1, warmup="first_chunk", chunk_size=200, stride=200, chunks_scanned=41
    ),
    "tum_vgg16": Preset(limit=95, min_part=4 / 5, k_run=30, warmup="none", chunks_scanned=83),
    "tum_vit": Preset(
        limit=10, chunk_size=30, stride=30, halve=True, report="b", chunks_scanned=165, excluded_chunks=(153,)
    ),
}
