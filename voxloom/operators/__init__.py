"""DataFrame-to-DataFrame operators on slice, voxel, run and case frames."""
