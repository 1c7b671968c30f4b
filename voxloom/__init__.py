"""PySpark-native operators for labelled voxel volumes, object tables, spatial graphs and deformation fields."""
