"""Plans that span several operators: snapshots, rendering, serving."""
