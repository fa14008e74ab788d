"""What has to walk a page's tree: plain Python, run over Arrow batches by the operators."""
