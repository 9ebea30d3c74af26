"""Part of quillstone; see README.md."""
