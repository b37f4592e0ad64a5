"""Events about metadata, in batch and as a stream."""
