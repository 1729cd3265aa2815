"""Result columns of the queries, the same for Spark and for SQL."""

from __future__ import annotations

_BOX = "x1:int y1:int x2:int y2:int"
_WINDOWS = " ".join(f"w{k}_{c}:int" for k in (0, 1) for c in ("x1", "y1", "x2", "y2"))
_PREFIX = "pr:int pg:int pb:int pa:int"
_RGBA = "r:int g:int b:int a:int"

COLUMNS = {
    "bitmap_to_pixels": "image_id:long y:int x:int v:int",
    "pixels_to_bitmap": "image_id:long width:int height:int data_hex:string",
    "rgba_pixels": f"image_id:long y:int x:int {_RGBA}",
    "rgba_normalize": f"image_id:long y:int x:int {_RGBA}",
    "rle_validate_dims": "image_id:long width:int height:int valid:boolean",
    "rle_runs": "image_id:long y:int run_idx:int x_start:int len:int v:int",
    "rle_run_codes": "image_id:long y:int run_idx:int code:string",
    "rle_encode": "image_id:long width:int height:int data_hex:string",
    "rle_encode_events": "image_id:long width:int height:int data_hex:string",
    "rle_encode_text": "image_id:long width:int height:int data_md5:string",
    "rle_encode_dense": "image_id:long width:int height:int data_hex:string error:string",
    "rle_decode_dense": "image_id:long width:int height:int data_hex:string error:string",
    "rle_encode_dense_arrow": "image_id:long width:int height:int data_hex:string error:string",
    "rle_decode_dense_arrow": "image_id:long width:int height:int data_hex:string error:string",
    "rle_size_ratio": "image_id:long n_pixels:long n_bytes:long",
    "rle_row_budget": "image_id:long y:int n_bytes:long width:int fits:boolean",
    "rle_tokenize": "image_id:long y:int run_idx:int x_start:int len:int v:int",
    "rle_decode": "image_id:long y:int x:int v:int",
    "rle_row_widths": "image_id:long height:long narrowest:long widest:long consistent:boolean",
    "rgba_histogram": f"image_id:long {_RGBA} n:long",
    "color_nibbles": f"image_id:long {_RGBA} " + " ".join(f"d{i}:int" for i in range(8)),
    "color_distance": "image_id:long y:int x:int distance:long",
    "palette_nearest": f"image_id:long {_RGBA} pid:int distance:long",
    "layout_validate_masks": "layout_id:long seq:long valid:boolean",
    "layout_screen": "layout_id:long y:int x:int",
    "layout_changed": "layout_id:long seq:long changed:boolean",
    "layout_container": f"layout_id:long {_BOX}",
    "layout_raw_container": f"layout_id:long {_BOX}",
    "layout_container_history": f"layout_id:long epoch:long {_BOX}",
    "layout_extended": f"layout_id:long {_BOX} ex1:int ey1:int ex2:int ey2:int",
    "layout_candidates": f"layout_id:long axis_rank:int pos:int {_WINDOWS} area:long",
    "layout_best_split": f"layout_id:long axis_rank:int pos:int {_WINDOWS} area:long",
    "layout_find": f"layout_id:long {_BOX} {_WINDOWS} flag:int",
    "hextree_levels": f"image_id:long level:int {_PREFIX} n:long",
    "hextree_level_counts": "image_id:long level:int n_nodes:long",
    "hextree_fold": f"image_id:long level:int {_PREFIX} n:long nchild:int folds:boolean",
    "hextree_palette": f"image_id:long pid:int level:int {_RGBA} n:long",
    "hextree_index": f"image_id:long {_RGBA} pid:int",
    "hextree_quantize": "image_id:long y:int x:int pid:int",
    "hextree_dither": "image_id:long y:int x:int pid:int",
    "hextree_dither_jjn": "image_id:long y:int x:int pid:int",
    "hextree_dither_sierra": "image_id:long y:int x:int pid:int",
    "utc_cluster_stats": "image_id:long cid:int weight:long mr:int mg:int mb:int ma:int chn:int max_err:int",
    "utc_split_choice": "image_id:long cid:int",
    "utc_first_split": f"image_id:long {_RGBA} n:long cid:int",
    "utc_palette_k8": f"image_id:long pid:int {_RGBA} n:long",
    "utc_index_k8": f"image_id:long {_RGBA} n:long pid:int",
    "utc_quantize": "image_id:long y:int x:int pid:int",
    "utc_dither": "image_id:long y:int x:int pid:int",
    "hextree_quantize_bitmap": "image_id:long width:int height:int data_hex:string error:string",
    "hextree_quantize_palette": f"image_id:long pid:int {_RGBA}",
    "utc_quantize_bitmap": "image_id:long width:int height:int data_hex:string error:string",
    "utc_quantize_palette": f"image_id:long pid:int {_RGBA}",
    "kmeans_palette": f"image_id:long pid:int {_RGBA} n:long",
    "capabilities": "operator:string implementation:string available:boolean version:string",
}
SQL_TYPES = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


def pairs(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in COLUMNS[name].split()]
