from .tables import empty_like, ensure_checkpoint_dir, materialize, shared_folder, table  # noqa: F401
