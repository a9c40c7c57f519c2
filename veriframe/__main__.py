"""``python -m veriframe``: --image, --train, --evaluate, --batch; --ingest, --prepare and --verify for data sets."""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veriframe", description="Tell generated images from photographs.")
    parser.add_argument("--image", "-i", help="classify one image")
    parser.add_argument("--train", "-t", nargs=2, metavar=("REAL", "GENERATED"), help="train on two folders")
    parser.add_argument("--evaluate", "-e", nargs=2, metavar=("REAL", "GENERATED"), help="evaluate on two folders")
    parser.add_argument("--batch", "-b", metavar="FOLDER", help="classify a folder")
    parser.add_argument("--ingest", nargs=2, metavar=("SOURCE", "TARGET"), help="clear TARGET and copy the images of SOURCE to it under new names")
    parser.add_argument("--prepare", nargs=3, metavar=("REAL", "GENERATED", "TEST"), help="move images to TEST/real and TEST/ai, then verify all folders")
    parser.add_argument("--verify", nargs=2, metavar=("REAL", "GENERATED"), help="verify two folders")
    parser.add_argument("--real-only", action="store_true", help="leave generated images out")
    parser.add_argument("--ai-only", action="store_true", help="leave real images out")
    parser.add_argument("--skip-split", action="store_true", help="move nothing")
    parser.add_argument("--model", "-m", default="models/svm_classifier", help="where the model is")
    a = parser.parse_args(args)
    if not (a.image or a.train or a.evaluate or a.batch or a.ingest or a.prepare or a.verify):
        parser.print_help()
        return 1
    from pyspark.sql import SparkSession

    from . import api
    from .operators.evaluate import summary
    from .sources.images import validate_path
    from .storage import cut, is_folder

    if a.image:
        try:
            validate_path(a.image)
        except (FileNotFoundError, ValueError) as e:
            print(f"Error: {e}", file=sys.stderr)
            return 1
    spark = SparkSession.builder.appName("veriframe").getOrCreate()
    if a.train:
        t = api.train(spark, *a.train, model_path=a.model)
        print(f"accuracy in cross-validation {t.cv_mean:.3f} (+/- {t.cv_std:.3f}), on the training rows {t.train_accuracy:.3f}; rows by class {t.counts}")
    elif a.evaluate:
        for df in api.evaluate(spark, *a.evaluate, model_path=a.model):
            df.show(truncate=False)
    elif a.image:
        for r in api.classify(spark, a.image, a.model).collect():
            print(r.explanation or f"{r.path}: {r.status}", *filter(None, [r.screenshot_warning]), sep="\n")
    elif a.batch:
        found = cut(api.classify(spark, a.batch, a.model).select("path", "status", "label", "confidence"), "batch")
        for r in found.orderBy("path").toLocalIterator():
            print(r.path, r.status if r.label is None else f"{r.label} ({r.confidence:.1%})")
        summary(found).show()
    elif a.ingest:
        print(api.ingest(spark, *a.ingest), "images copied")
    else:
        wanted = [k for k, left_out in ((0, a.ai_only), (1, a.real_only)) if not left_out]
        folders = [(a.prepare or a.verify)[k] for k in wanted]
        if a.prepare:
            tests = [f"{a.prepare[2].rstrip('/')}/{('real', 'ai')[k]}" for k in wanted]
            if not a.skip_split:
                for folder, test in zip(folders, tests, strict=True):
                    print(f"{folder}: {api.split(spark, folder, test)} images moved to {test}")
            folders += [t for t in tests if is_folder(spark, t)]
        report = api.verify(spark, folders).collect()  # a row a folder
        for r in report:
            print(f"{r.dir}: {r.n} images, {r.corrupt} corrupt, {r.low_res} under 512 pixels", "passed" if r.passed else "FAILED: " + ", ".join(r.bad_files))
        return int(not all(r.passed for r in report))
    return 0


if __name__ == "__main__":
    sys.exit(main())
