"""Schemas, as DDL, of steps, trajectories, tasks, contexts, scores and transcripts."""

from __future__ import annotations

MESSAGE = "struct<role:string,content:string>"
STEP_DDL = (
    "step_idx int, thought string, action string, observation string, done boolean, info map<string,string>, "
    "token_usage_prompt int, token_usage_completion int, token_usage_total int, llm_exec_time double, env_exec_time double, "
    "total_step_time double, total_time_traj double, step_count int"
)
STEP = "struct<" + ", ".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in STEP_DDL.split(", "))) + ">"
TRAJECTORY = (
    f"trajectory_steps array<{STEP}>, problem_statement string, docker_image string, exp_name string, ds string, max_steps int, "
    "max_steps_absolute int, max_token_limit int, max_llm_time int, max_exec_time int, max_total_time int, exit_reason string, output_patch string, "
    "reward double, reward_calc_time double, test_output string, regression_test_output string, verifier_prob double"
)
TASK = (
    "repo string, repo_name string, base_commit string, new_commit_hash string, problem_statement string, commit_date string, docker_image string, "
    "patch string, test_patch string, modified_not_test_files array<string>, modified_test_files array<string>, "
    "non_test_file_content map<string,struct<old_file_content:string,new_file_content:string>>, test_exec_content map<string,string>, "
    "FAIL_TO_PASS string, PASS_TO_PASS string"
)
CONTEXT = (
    "instance_id string, real_output string, real_error_code int, real_reward double, context struct<type:string,repo:string,language:string,"
    "problem_statement:string,command_to_simulate:string,agent_patch:string,gold_patch:string,test_patch:string,"
    "execution_code_content:map<string,string>,original_files_content:map<string,string>,initial_analysis:string,FAIL_TO_PASS:string,PASS_TO_PASS:string>"
)
SCORED = (
    "instance_id string, num_scores int, simulated_reward_runs array<struct<simulated_reward:double,sim_test_report:string,sim_response_content:string>>, "
    "simulated_reward_avg double, sim_valid_runs int, sim_bad_runs int, sim_total_runs int, real_reward int"
)
VERIFIER = ("docker_images string, exp_names string, avg_yes_prob double, gt_correct int, num_steps int, patch_size int, p2p_rate double, exit_reasons string")
SFT_ROW = (f"input array<{MESSAGE}>, token_usage_total bigint, step_count int, reward double")
TOKENISED = ("prompt string, response string, prompt_ids_len int, response_ranges array<struct<start:int,end:int>>")
