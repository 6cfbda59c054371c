from .distance import box_distance, hyperplane_offset, right_of, sq_distance, sq_distance_arrays, sq_distance_float32

__all__ = ["box_distance", "hyperplane_offset", "right_of", "sq_distance", "sq_distance_arrays", "sq_distance_float32"]
